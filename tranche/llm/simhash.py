"""SimHash near-dedup by meet-in-the-middle ball hashing.

Documents with equal fingerprints collapse first, so a group of copies costs one fingerprint. Each distinct fingerprint
then emits all variants within half the radius. Two fingerprints within the radius share a variant, so grouping by the
variant finds every link. Only the fingerprints of one ball can emit a variant, so a group never exceeds that ball
(65 members at radius 2), however large the corpus or its groups of copies are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from operator import xor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tranche.llm.common import components, map_batches, written_once

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at once: bounds the memory for very long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text; a null text is empty, and no words give zero.

    A-Z are lower-cased, words are split at ASCII white space, repeated shingles count each time. A text of fewer than
    ``words`` words is one shingle. A bit is set if it is set in over half of the shingle hashes.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    n = max(1, len(tokens) - words + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=n)
    set_in = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, CHUNK):
        part = hashes[start : start + CHUNK]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_in * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the fingerprint as a signed long. Repeated rows and null ids are kept."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(picked, run, f"doc_id {kind}, fp long")


def hex_digits(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ball_masks(radius: int) -> list[int]:
    """Signed long masks with at most ``radius`` bits set; the empty one comes first."""
    masks = [reduce(xor, (1 << b for b in bits), 0) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Star edges ``(a, b)`` over distinct fingerprints ``fp`` that join exactly what pairs within ``distance`` join.

    Members of one variant's group are linked to the smallest of them: both are within half the radius of the variant,
    so within the radius of each other, which every edge is still verified for.
    """
    if distance % 2:
        raise ValueError("the distance must be even: half of it is the radius of the balls")
    masks = ball_masks(distance // 2)
    around = lambda c: F.explode(F.array(*[F.col(c).bitwiseXOR(F.lit(m)) for m in masks]))
    # Spread the few bytes of the fingerprints over all tasks before each of them becomes a ball.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = spread.select("fp", around("fp").alias("variant")).groupBy("variant")
    met = met.agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = written_once(met, "simhash-variants")
    pairs = met.where("n = 2").select("a", "b")
    # The members of a larger group are those fingerprints that lie in the ball around its variant.
    crowded = met.where("n > 2").select("a", around("variant").alias("fp")).join(fps, "fp").select("a", F.col("fp").alias("b"))
    found = pairs.unionByName(crowded).where("a < b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fp``, ``component_id`` (the smallest id reachable) and ``n_rows`` of the component.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated and share a
    component; a null id never is a component's id unless all its ids are null. An empty table gives an empty result.
    """
    prints = written_once(fingerprints(docs, doc_id, text, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = written_once(distinct, "simhash")
    linked = components(links(distinct.select("fp"), distance), "simhash")
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("n_rows"))
    by_print = rooted.select("fp", "root").join(heads, "root").select("fp", "component_id", "n_rows")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "n_rows")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2
) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, that with the smallest id. All columns are kept.

    Rows that repeat a kept id are one document, of which one row stays. Rows without an id all stay: nothing names them.
    """
    found = near_duplicates(docs, doc_id, text, words, distance)
    stay = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    stay = written_once(stay, "simhash")
    kept = lambda some: docs.join(some, docs[doc_id] == some["doc_id"], "left_semi")
    nameless = docs.where(F.col(doc_id).isNull())
    return kept(stay.where("n = 1")).union(kept(stay.where("n > 1")).dropDuplicates([doc_id])).union(nameless)
