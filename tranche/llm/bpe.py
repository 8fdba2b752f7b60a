"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut as the tokenizers library cuts them: first around the added tokens (whose strings become their ids),
then by the pre-tokenising pattern, each piece's UTF-8 bytes shown as one character per byte. The pieces of a batch
that were not seen before are merged together: every adjacent pair of symbols in all of them is indexed by its
position, as arrays over all pieces of about a length. A round merges in every piece the leftmost place of its lowest
rank and indexes anew the two pairs that the merge makes with the neighbours. Pieces too long for that share an index
from pairs to positions, whose ranks are applied in ascending order. Both are the order of the library, which merges
the lowest rank first and, within a rank, the leftmost place. Merged pieces are remembered up to a bound, so a task's
memory stays bounded.

Nulls: a null text encodes as no ids; null ids decode as ``""``. Empty texts give no ids. Ids outside the vocabulary
are refused when decoding. Every text is encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tranche.llm.common import fresh, map_batches

#: Fixed value: the pre-tokenising pattern of byte-level BPE, as the public vocabularies give it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern over ASCII, where letters, numbers and spaces are these.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
#: Widths in bytes of the arrays that hold pieces to merge; longer pieces are merged by ``merge_long``.
WIDTHS = [8, 16, 32, 64]
#: Pieces merged together in arrays.
BLOCK = 8192
#: The value of a pair that doesn't merge; others are ``rank << 32 | merged id``.
NO_MERGE = np.iinfo(np.int64).max
#: Pieces remembered by a task with their ids; the memory is cleared when it holds more.
REMEMBERED = 200_000


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes: printable Latin-1 bytes for themselves, the others for 256 upwards in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {}, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


@dataclass
class Vocabulary:
    """Ids of the pieces, merges as ``(left id, right id) -> (rank, merged id)``, the bytes of every id, added tokens."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    token_bytes: list[bytes]
    added: dict[str, int]
    byte_ids: list[int]

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Merges as arrays, in order of ``left id << 32 | right id``: those keys, and ``rank << 32 | merged id``."""
        keys = np.array([left << 32 | right for left, right in self.merges], np.int64)
        values = np.array([rank << 32 | merged for rank, merged in self.merges.values()], np.int64)
        order = np.argsort(keys)
        # A last key beyond all others, so that every search ends inside the table.
        return np.append(keys[order], NO_MERGE), np.append(values[order], NO_MERGE)

    def pair_values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 32 | merged id`` of pairs of ids, ``NO_MERGE`` where they don't merge or the right one is none (-1)."""
        keys, values = self.pair_table
        wanted = left << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), values[at], NO_MERGE)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary in the JSON form of the tokenizers library (``model.vocab``, ``model.merges``)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids = dict(model["vocab"])
    back = {c: b for b, c in byte_characters().items()}
    added = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", [])}
    size = max([*ids.values(), *added.values()]) + 1
    token_bytes = [b""] * size
    for piece, i in ids.items():
        token_bytes[i] = bytes(back[c] for c in piece)
    for piece, i in added.items():
        token_bytes[i] = piece.encode("utf-8")
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ", 1) if isinstance(pair, str) else pair
        merges[(ids[left], ids[right])] = (rank, ids[left + right])
    characters = byte_characters()
    return Vocabulary(ids, merges, token_bytes, added, [ids[characters[b]] for b in range(256)])


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each piece, merged together with those of about its length."""
    out: list[list[int]] = [[]] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    least = 0
    for width in WIDTHS:
        fitting = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        for start in range(0, len(fitting), BLOCK):
            chosen = fitting[start : start + BLOCK]
            symbols = merge_short([pieces[i] for i in chosen], sizes[chosen], width, vocab)
            for i, row, n in zip(chosen.tolist(), symbols.tolist(), (symbols >= 0).sum(axis=1).tolist()):
                out[i] = row[:n]
    long = np.flatnonzero(sizes > least).tolist()
    for i, ids in zip(long, merge_long([pieces[i] for i in long], vocab)):
        out[i] = ids
    return out


def merge_short(pieces: list[bytes], sizes: np.ndarray, width: int, vocab: Vocabulary) -> np.ndarray:
    """Ids of pieces of at most ``width`` bytes, a row each, filled up with -1."""
    rows = len(pieces)
    filled = np.arange(width) < sizes[:, None]
    done = np.full((rows, width), -1, np.int64)
    done[filled] = np.array(vocab.byte_ids, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
    # Symbols end in a column of none; pairs[:, i] is the value of the pair at i, which the column after the last never has.
    symbols = np.append(done, np.full((rows, 1), -1, np.int64), axis=1)
    pairs = np.full((rows, width), NO_MERGE)
    pairs[:, :-1] = vocab.pair_values(symbols[:, : width - 1], symbols[:, 1:width])
    place, columns = np.arange(rows), np.arange(width)
    while len(place):
        first = pairs.argmin(axis=1)
        each = np.arange(len(place))
        value = pairs[each, first]
        merging = value != NO_MERGE
        if not merging.all():
            done[place[~merging]] = symbols[~merging, :width]
            place, symbols, pairs, first, value = place[merging], symbols[merging], pairs[merging], first[merging], value[merging]
            each = each[: len(place)]
            if not len(place):
                break
        merged = value & 0xFFFFFFFF
        # Everything behind the merged place moves up by one.
        behind = columns > first[:, None]
        symbols[:, :width] = np.where(behind, symbols[:, 1:], symbols[:, :width])
        symbols[each, first] = merged
        pairs[:, :-1] = np.where(behind[:, :-1], pairs[:, 1:], pairs[:, :-1])
        pairs[each, first] = vocab.pair_values(merged, symbols[each, first + 1])
        left = np.flatnonzero(first)
        pairs[left, first[left] - 1] = vocab.pair_values(symbols[left, first[left] - 1], merged[left])
    return done


def merge_long(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each piece: all pieces' pairs are indexed by position, then ranks are applied in ascending order."""
    byte_ids = vocab.byte_ids
    symbol = [byte_ids[b] for piece in pieces for b in piece]
    size = len(symbol)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    starts, at = [], 0
    for piece in pieces:
        starts.append(at)
        if piece:
            before[at] = -1
            at += len(piece)
            after[at - 1] = -1
    alive = [True] * size
    merges = vocab.merges
    where: dict[tuple[int, int], list[int]] = {}
    ranks: list[tuple[int, tuple[int, int]]] = []
    push = heapq.heappush
    for pos in range(size - 1):
        if after[pos] < 0:
            continue
        pair = (symbol[pos], symbol[pos + 1])
        found = merges.get(pair)
        if found is not None:
            places = where.get(pair)
            if places is None:
                where[pair] = [pos]
                push(ranks, (found[0], pair))
            else:
                places.append(pos)
    while ranks:
        _, pair = heapq.heappop(ranks)
        places = where.pop(pair)
        left, right = pair
        merged = merges[pair][1]
        for pos in sorted(set(places)) if len(places) > 1 else places:
            nxt = after[pos]
            if not alive[pos] or nxt < 0 or symbol[pos] != left or symbol[nxt] != right:
                continue
            symbol[pos] = merged
            alive[nxt] = False
            nxt = after[pos] = after[nxt]
            if nxt >= 0:
                before[nxt] = pos
            # The pairs that the merge makes with both neighbours are indexed at their places.
            for place, other in ((before[pos], pos), (pos, nxt)):
                if place < 0 or other < 0:
                    continue
                made = (symbol[place], symbol[after[place]])
                found = merges.get(made)
                if found is not None:
                    known = where.get(made)
                    if known is None:
                        where[made] = [place]
                        push(ranks, (found[0], made))
                    else:
                        known.append(place)
    out = []
    for piece, start in zip(pieces, starts):
        ids, pos = [], start if piece else -1
        while pos >= 0:
            ids.append(symbol[pos])
            pos = after[pos]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts batch by batch; pieces are merged once per batch through the pair index and then remembered."""

    def __init__(self, vocab: Vocabulary, split_added: bool = True) -> None:
        self.vocab = vocab
        #: Pieces seen with their ids as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.ascii_pattern = re.compile(ASCII_PATTERN)
        added = sorted(vocab.added, key=len, reverse=True) if split_added else []
        self.added = regex.compile("|".join(regex.escape(a) for a in added)) if added else None

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """``(is added token, string)`` in order: added tokens are cut out first, leftmost and longest."""
        if self.added is None or not self.added.search(text):
            return [(False, text)]
        out, at = [], 0
        for hit in self.added.finditer(text):
            if hit.start() > at:
                out.append((False, text[at : hit.start()]))
            out.append((True, hit.group()))
            at = hit.end()
        if at < len(text):
            out.append((False, text[at:]))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known, added = self.known, self.vocab.added
        split, split_ascii = self.pattern.findall, self.ascii_pattern.findall
        cut = []
        seen: set[str] = set()
        for text in texts:
            pieces = []
            for special, part in self.parts(text or ""):
                if special:
                    pieces.append(part)
                    continue
                found = split_ascii(part) if part.isascii() else split(part)
                seen.update(found)
                pieces.append(found)
            cut.append(pieces)
        new = [p for p in seen if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(seen)
        merged = merge_pieces([p.encode("utf-8") for p in new], self.vocab)
        packed, at = np.fromiter(chain.from_iterable(merged), "<u4").tobytes(), 0
        for piece, ids in zip(new, merged):
            known[piece] = packed[at : (at := at + 4 * len(ids))]
        lookup = known.__getitem__
        out = []
        for pieces in cut:
            ids = [added[found].to_bytes(4, "little") if isinstance(found, str) else b"".join(map(lookup, found)) for found in pieces]
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def shared_encoder(path: str, split_added: bool = True) -> Encoder:
    """One encoder per vocabulary in a Python worker: Spark reuses workers across tasks, so the vocabulary is read
    once and remembered pieces serve later tasks too (still at most ``REMEMBERED``)."""
    key = (path, split_added)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load(path), split_added)
    return _ENCODERS[key]


def decode_ids(ids, vocab: Vocabulary) -> str:
    """The text of ``ids``: their bytes joined, read as UTF-8 with replacement characters for broken sequences."""
    if ids is None:
        return ""
    size = len(vocab.token_bytes)
    if any(i is None or i < 0 or i >= size for i in ids):
        raise ValueError("an id outside the vocabulary")
    return b"".join(map(vocab.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def decode_packed(ids: bytes, vocab: Vocabulary) -> str:
    """``decode_ids`` of ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(ids, "<u4")
    if len(ids) and ids.max() >= len(vocab.token_bytes):
        raise ValueError("an id outside the vocabulary")
    return b"".join(map(vocab.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """Texts' ids, given as little-endian unsigned 32-bit integers, as lists of integers."""
    ends = np.cumsum([0, *[len(ids) // 4 for ids in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, vocab_path: str | None = None, text: str = "text", out: str = "ids", split_added: bool = True) -> DataFrame:
    """``df`` with ``out``: array<int> of the ids of ``text``. All columns are kept; ``out`` is renamed if taken."""
    path = vocab_path or public_vocabulary()
    out = fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, split_added)
        for batch in batches:
            ids = id_lists(encoder.encode_packed(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], schema=pa.schema([*batch.schema, pa.field(out, pa.list_(pa.int32()), False)]))

    return map_batches(df, run, schema)


def decode(df: DataFrame, vocab_path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of ``ids`` as the library decodes it, special tokens kept."""
    path = vocab_path or public_vocabulary()
    out = fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            texts = [decode_ids(i, vocab) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field(out, pa.string(), False)]))

    return map_batches(df, run, schema)


def ids_digest(df: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """``df`` with the SHA-256 (lower-case hex) of ``ids`` as little-endian unsigned 32-bit integers; null ids as none."""
    out = fresh(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            digests = [hashlib.sha256(np.asarray(v or [], dtype="<u4").tobytes()).hexdigest() for v in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], schema=pa.schema([*batch.schema, pa.field(out, pa.string(), False)]))

    return map_batches(df, run, schema)


def round_trip(df: DataFrame, vocab_path: str | None = None, text: str = "text", split_added: bool = True) -> DataFrame:
    """``df`` with ``ids``, ``ids_sha256`` and ``decoded`` (the text of those ids) from one pass over each batch.

    The same as ``encode`` then ``ids_digest`` and ``decode``, without sending the ids back to Python twice.
    """
    path = vocab_path or public_vocabulary()
    names = [fresh(df, "ids"), fresh(df, "ids_sha256"), fresh(df, "decoded")]
    kinds = [T.ArrayType(T.IntegerType(), False), T.StringType(), T.StringType()]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k, False) for n, k in zip(names, kinds)]])
    arrow = [pa.list_(pa.int32()), pa.string(), pa.string()]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, split_added)
        vocab = encoder.vocab
        for batch in batches:
            packed = encoder.encode_packed(batch.column(at).to_pylist())
            digests = [hashlib.sha256(ids).hexdigest() for ids in packed]
            texts = [decode_packed(ids, vocab) for ids in packed]
            columns = [id_lists(packed), pa.array(digests, arrow[1]), pa.array(texts, arrow[2])]
            fields = [*batch.schema, *[pa.field(n, k, False) for n, k in zip(names, arrow)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema(fields))

    return map_batches(df, run, schema)
