"""Document fingerprints by Order MinHash.

Every k-mer of a text counts with its occurrence number, so that repetitions are told apart. Hashes of (k-mer, number)
are dealt to slots by their leading bits; a slot selects its smallest ones, puts these back into text order and hashes
the tuple of their k-mers. Two texts agree in a slot only if the same k-mers come in the same order there, so likeness
follows edit distance: moved passages and inserted text cost slots even where the sets of k-mers agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import map_batches

K = 12
SLOTS = 64
TUPLE = 2
#: Sorts before all ids that are whole numbers: a document without an id comes last.
NO_ID = -(1 << 63)
MULTIPLIER, MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX
    h = (h ^ (h >> SHIFT)) * MIX
    return h ^ (h >> SHIFT)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each window of ``k`` code points, by doubling windows; a shorter text is one window."""
    if not len(points):
        return np.zeros(0, np.uint64)
    h = mixed(points.astype(np.uint64) + MULTIPLIER)
    k = min(k, len(points))
    out, have, n, width = None, 0, len(h), 1
    # Windows of 1, 2, 4, ... are joined to one of k.
    while width <= k:
        if k & width:
            part = h[have : have + n - k + 1]
            out = part if out is None else out * MULTIPLIER + (part ^ (part >> SHIFT))
            have += width
        if 2 * width <= k:
            h = h[:-width] * MULTIPLIER + (h[width:] ^ (h[width:] >> SHIFT))
        width *= 2
    return mixed(out)


def numbered(h: np.ndarray) -> np.ndarray:
    """The occurrence number of each hash among its equals, in text order."""
    n = len(h)
    bits = max(1, int(n - 1).bit_length())
    mask = np.uint64((1 << bits) - 1)
    # The leading bits of the hash with the place below: sorting these groups equals and keeps their order.
    packed = np.sort((h & ~mask) | np.arange(n, dtype=np.uint64))
    group, place = packed & ~mask, (packed & mask).astype(np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(group[1:], group[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    number = np.empty(n, np.uint64)
    number[place] = (np.arange(n) - first).astype(np.uint64)
    return number


def sketch(h: np.ndarray, slots: int = SLOTS, size: int = TUPLE) -> np.ndarray:
    """One number below 65536 for each slot, 0 for a slot without k-mers; ``h`` are k-mer hashes in text order."""
    if not len(h):
        return np.zeros(slots, np.uint16)
    n = len(h)
    order = mixed(h + (numbered(h) + np.uint64(1)) * MULTIPLIER)
    bits = max(1, int(n - 1).bit_length())
    mask = np.uint64((1 << bits) - 1)
    slot_shift = np.uint64(64 - int(slots).bit_length() + 1)
    # Only hashes that are small within their slot can be selected. Rows are thinned by a bound that leaves about eight a
    # slot, and taken whole where a slot is left with too few.
    low = order << np.uint64(int(slots).bit_length() - 1)
    few = min(1.0, 8.0 * size * slots / n)
    kept = np.arange(n) if few == 1.0 else np.flatnonzero(low < np.uint64(int(few * 2**64)))
    if few < 1.0:
        have = np.bincount((order[kept] >> slot_shift).astype(np.int64), minlength=slots)
        if have.min() < size:
            kept = np.arange(n)
    packed = np.sort((order[kept] & ~mask) | kept.astype(np.uint64))
    slot = (packed >> slot_shift).astype(np.int64)
    first = np.searchsorted(slot, np.arange(slots))
    count = np.diff(np.append(first, len(slot)))
    out = np.zeros(slots, np.uint64)
    chosen = np.full((slots, size), np.iinfo(np.int64).max)
    for i in range(size):
        has = count > i
        chosen[has, i] = (packed[first[has] + i] & mask).astype(np.int64)
    chosen.sort(axis=1)  # text order
    for i in range(size):
        has = chosen[:, i] < n
        out[has] = mixed(out[has] * MULTIPLIER + h[chosen[has, i]] + np.uint64(i + 1))
    filled = count > 0
    return np.where(filled, out % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def digits(sketched: np.ndarray) -> str:
    """Four hexadecimal digits for each slot."""
    return sketched.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either text fills; 1 if neither fills any."""
    filled = (a > 0) | (b > 0)
    return float((a[filled] == b[filled]).mean()) if filled.any() else 1.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for every row: the slots in hexadecimal. Null texts are empty; ids may be null or repeat."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digits(sketch(kmer_hashes(code_points(t.as_py() or "")))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp string").withColumnRenamed("fp", "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of the text (rounded down), replaced by as many first characters of the following one, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def dealt(docs: DataFrame, most_chars: int) -> DataFrame:
    """``(range, extra, doc_id, text)`` in ranges of descending id, each range with what follows its last document.

    A range has about ``most_chars`` characters, and there are as many as shuffle partitions at least. Bounds are quantiles
    of all ids: one long a range, in an array that is searched. The documents of a range's first id are sent to the range
    before as well (those of the very first id to the last range), marked as extra and sorted behind its own.
    """
    session = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-chars // most_chars))
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = ids.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 20 * ranges))).alias("cuts")).first()["cuts"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(some: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, some.to_numpy(), "left"), dtype="int32")

    firsts = ids.select("id", range_of("id").alias("range")).groupBy("range").agg(F.max("id").alias("id")).collect()
    firsts = sorted((r["range"], r["id"]) for r in firsts)
    first_ids = np.array([i for _, i in reversed(firsts)], np.int64)  # ascending
    before = np.array([firsts[n - 1][0] for n in range(len(firsts))][::-1], np.int32)

    @F.pandas_udf("int")
    def ends(some: pd.Series) -> pd.Series:
        found = np.minimum(np.searchsorted(first_ids, some.to_numpy()), len(first_ids) - 1)
        return pd.Series(np.where(first_ids[found] == some.to_numpy(), before[found], -1), dtype="int32")

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), "doc_id", "text")
    rows = rows.select("*", F.array(range_of("id"), ends("id")).alias("to"))
    each = rows.select("id", "doc_id", "text", F.posexplode("to").alias("extra", "range")).where("range >= 0")
    spread = each.repartitionById(ranges, F.col("range"))
    ordered = spread.withColumn("h", F.xxhash64("text")).sortWithinPartitions("range", "extra", F.desc("id"), F.desc("h"))
    return ordered.select("range", "extra", "doc_id", "text")


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_chars: int = 64_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends as the next document begins, in descending id.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row. After the
    last document comes the first; a single document follows itself. Null texts are empty. Equal ids come in the order of
    a hash of their texts; null ids come last. Texts are shuffled once, in ranges of ids, and read one after the other.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids must be whole numbers: they are cut into ranges")
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for where, extra, key, body in zip(*batch.columns, strict=True):
                body = body.as_py()
                this = (where.as_py(), key.as_py(), body, sketch(kmer_hashes(code_points(body))))
                if last is not None and last[0] == this[0]:
                    out.append(compared(last, this))
                last = None if extra.as_py() else this
            names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    found = map_batches(dealt(picked, most_chars), run, "doc_id long, n_chars long, edited_sha256 string, fp string, edited_fp string, near_edited double, near_next double")
    return found.withColumnsRenamed({"fp": "fingerprint", "edited_fp": "edited_fingerprint"}).withColumn("doc_id", F.col("doc_id").cast(kind))


def compared(this: tuple, following: tuple) -> tuple:
    _, key, text, own = this
    changed = edited(text, following[2])
    other = sketch(kmer_hashes(code_points(changed)))
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, digits(own), digits(other), likeness(own, other), likeness(own, following[3])
