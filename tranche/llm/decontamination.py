"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters is found where a text holds it with at most k edits. It is cut into k + 1 pieces; k edits leave
one piece untouched, so only the surroundings of exact piece hits can hold the item. Those are verified with Myers'
bit-parallel edit distance. Texts are scanned once for all pieces; nothing is shuffled but the matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import map_batches

#: Characters of benchmark items that are shipped to the tasks at once; a larger benchmark is scanned in as many passes.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces; null is empty."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length with their offsets; they cover the item."""
    n = min(edits, len(item) - 1) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between ``item`` and any substring of ``text``, and the first end of such a substring."""
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        right = minus | (full & ~(diagonal | plus))
        left = plus & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1  # a match may start anywhere: row 0 stays at zero
        plus = full & (left | ~(diagonal | right))
        minus = full & right & diagonal
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(key, text, budget(len(text), rate)) for key, text in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, users in found.items():
            self.automaton.add_word(piece, (len(piece), users))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[object, int, int]]:
        """``(item, distance, end)``: the least distance of each item found, at its first place in the normal text."""
        if not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        exact: dict[int, int] = {}
        for last, (length, users) in self.automaton.iter(text):
            for n, offset in users:
                start = last + 1 - length - offset
                _, item, edits = self.items[n]
                if n in exact:
                    continue
                if start >= 0 and text.startswith(item, start):
                    exact[n] = start + len(item)
                else:
                    spans[n].append((max(0, start - edits), start + len(item) + edits))
        out = [(self.items[n][0], 0, end) for n, end in exact.items()]
        for n in spans.keys() - exact.keys():
            key, item, edits = self.items[n]
            best, at = edits + 1, 0
            for a, b in merged(spans[n]):
                distance, end = myers(item, text[a:b])
                if distance < best:
                    best, at = distance, a + end
            if best <= edits:
                out.append((key, best, at))
        return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping windows as one, so that no place of a text is verified twice for an item."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, least_chars: int, block_chars: int) -> Iterator[pa.Table]:
    """The items of at least ``least_chars`` characters in blocks of about ``block_chars``, dealt by hash, one at a time."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = items.where(F.length("text") >= least_chars)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield some.toArrow()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = 0.05,
    least_chars: int = 20,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(doc_id, item_id, distance, end)`` for every document row and item it holds within ``rate`` edits a character.

    ``end`` is the end of the first best match in the normalised text. Items under ``least_chars`` normalised characters
    (null and empty ones among them) say nothing and match nothing. Null texts are empty; null ids are reported as null;
    repeated rows and repeated items are reported each. An empty table on either side gives no rows. The benchmark is
    shipped in blocks of at most ``block_chars`` characters, each a pass over the documents.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, end long"
    out = None
    for items in item_blocks(benchmark, item_id, item_text, least_chars, block_chars):
        found = map_batches(picked, scan(items, rate, least_chars), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def long_enough(items: pa.Table, least_chars: int) -> list[tuple[int, str]]:
    """Position and normal text of the items that are long enough in normal form too."""
    texts = ((n, normal(t.as_py())) for n, t in enumerate(items.column(1)))
    return [x for x in texts if len(x[1]) >= least_chars]


def scan(items: pa.Table, rate: float, least_chars: int):
    """A function over batches ``(doc_id, text)`` that reports the matches of these items."""
    keys, texts = items.column(0).combine_chunks(), long_enough(items, least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(texts, rate)
        for batch in batches:
            found = [(row, *match) for row, text in enumerate(batch.column(1)) for match in block.matches(normal(text.as_py()))]
            rows, which, distances, ends = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    keys.take(pa.array(which, pa.int64())),
                    pa.array(distances, pa.int32()),
                    pa.array(ends, pa.int64()),
                ],
                names=["doc_id", "item_id", "distance", "end"],
            )

    return run


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = 0.05,
    least_chars: int = 20,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Each row is judged by its own text."""
    column = docs.columns.index(text)

    def without(texts: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Items(texts, rate)
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(normal(t.as_py())) for t in batch.column(column)], pa.bool_()))

        return run

    for items in item_blocks(benchmark, item_id, item_text, least_chars, block_chars):
        docs = map_batches(docs, without(long_enough(items, least_chars)), docs.schema)
    return docs
