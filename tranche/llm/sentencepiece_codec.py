"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

No piece holds a whitespace marker behind another character (checked), so the best segmentation of a text is that of its
chunks, each a run of markers with the characters up to the next run. Distinct chunks of a batch are segmented together:
all start positions of all chunks walk the double array in lockstep as numpy arrays. Chunks recur, and are remembered up
to a bound. Characters outside the vocabulary become one byte piece for each UTF-8 byte.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tranche.llm.common import fresh, map_batches

MARK = "▁"
#: Log score of a byte piece: below any piece of the vocabulary by this much for each byte.
BYTE_PENALTY = 10.0
#: Longer chunks are segmented one by one, so that a text without spaces needs no wide matrix.
LONG = 64
#: Pieces that are shipped to the tasks: a vocabulary has a bounded size, which is checked.
MOST_PIECES = 1_000_000
#: Places of the double array that are tried at once.
WINDOW = 1024
#: Chunks segmented together.
BLOCK = 8192


@dataclass
class Vocabulary:
    """Pieces with log scores, and the double array of their trie: node ``n`` has the child ``base[n] + c`` if ``check`` of that is ``n``."""

    pieces: list[str]
    scores: np.ndarray
    bytes_at: np.ndarray
    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int


def public_model() -> str:
    """Path of the public vocabulary with byte fallback that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_scores(ranks: np.ndarray) -> np.ndarray:
    """Log scores of merge-ranked pieces by Zipf's law: the piece of rank r has a probability in proportion to 1 / (r + 1)."""
    weights = 1.0 / (ranks + 1.0)
    return np.log(weights / weights.sum())


def load(path: str, scores: str = "zipf") -> Vocabulary:
    """Read a model file. ``scores``: "model" for the file's own log scores, "zipf" for a file that ranks merges instead.

    Control and unknown pieces are never produced. The file needs a byte piece for every byte.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces; at most {MOST_PIECES} are shipped to the tasks")
    pieces = [model.id_to_piece(i) for i in range(n)]
    bytes_at = np.full(256, -1, dtype=np.int32)
    normal = []
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal.append(i)
    if (bytes_at < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    found = np.full(n, -np.inf)
    given = np.array([model.get_score(i) for i in normal])
    if scores == "zipf":
        ranks = np.argsort(np.argsort(-given, kind="stable"), kind="stable")
        given = rank_scores(ranks.astype(float))
    found[normal] = given
    found[bytes_at] = given.min() - BYTE_PENALTY
    return build(pieces, found, bytes_at, normal)


def build(pieces: list[str], scores: np.ndarray, bytes_at: np.ndarray, normal: list[int]) -> Vocabulary:
    if any(MARK in pieces[i].lstrip(MARK) for i in normal):
        raise ValueError("a piece holds a whitespace marker behind another character: chunks can't be segmented apart")
    codes = {c: n for n, c in enumerate(sorted({c for i in normal for c in pieces[i]}), 1)}
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for i in normal:
        node = 0
        for c in pieces[i]:
            node = children[node].setdefault(codes[c], len(children))
            if node == len(children):
                children.append({})
                ids.append(-1)
        if ids[node] < 0 or scores[i] > scores[ids[node]]:
            ids[node] = i
    # The first free places that fit all children of a node. An only child fills holes; others skip crowded windows.
    size = 4 * (len(children) + len(codes)) + WINDOW
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    hole = uncrowded = len(codes) + 1
    todo = deque([(0, 0)])
    while todo:
        node, place = todo.popleft()
        value[place] = ids[node]
        if not children[node]:
            continue
        letters = np.fromiter(children[node], np.int64)
        first = letters.min()
        start = uncrowded
        if len(letters) == 1:
            hole += int(np.argmax(free[hole : hole + size]))
            start = hole
        while True:
            places = start + np.flatnonzero(free[start : start + WINDOW]) - first
            fits = places[free[places[:, None] + letters].all(axis=1)]
            if len(fits):
                break
            if start == uncrowded and 4 * len(places) < WINDOW:
                uncrowded += WINDOW
            start += WINDOW
        at = int(fits[0])
        base[place] = at
        check[at + letters] = place
        free[at + letters] = False
        todo.extend((child, at + letter) for letter, child in children[node].items())
    return Vocabulary(pieces, scores, bytes_at, codes, base, check, value, max((len(pieces[i]) for i in normal), default=1))


class Codec:
    """Encodes and decodes whole texts. Remembers chunks, up to a bound."""

    MOST_CHUNKS = 200_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        byte_of = {int(i): bytes([b]) for b, i in enumerate(vocabulary.bytes_at)}
        self.code_of = np.zeros(0x110000, np.int32)
        for c, code in vocabulary.codes.items():
            self.code_of[ord(c)] = code
        self.code_of[ord(" ")], self.code_of[ord(MARK)] = vocabulary.codes.get(MARK, 0), 0
        self.written = [byte_of.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece ids of each text. Null and empty texts have none.

        A marker is put in front, as for a first word; a marker in the text itself is written as bytes, so that decoding
        gives back every text as it was.
        """
        if len(self.known) > self.MOST_CHUNKS:
            self.known.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        new = list({c for chunks in cut for c in chunks} - self.known.keys())
        self.known.update(self.segment(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), dtype=np.int32) for chunks in cut]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A chunk has a blank for the marker, so that a marker in the text stays apart from it."""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return re.findall(r" +[^ ]*", " " + text)
        return [" " + word for word in text.split(" ")]

    def letters(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trie code (0: in no piece) and number of UTF-8 bytes of each character of chunks."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code_of[points], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        out = {c: self.long(c) for c in chunks if len(c) > LONG}
        short = sorted((c for c in chunks if len(c) <= LONG), key=len)
        for start in range(0, len(short), BLOCK):
            out.update(self.together(short[start : start + BLOCK]))
        return out

    def together(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks in order of length, a start position after the other for all of them."""
        lengths = np.array([len(c) for c in chunks])
        width, n, longest = int(lengths[-1]), len(chunks), self.v.longest
        flat, sizes = self.letters("".join(chunks))
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grid, as_bytes = np.zeros((width + longest, n), np.int32), np.zeros((width, n))
        grid[place, row] = flat
        as_bytes[place, row] = sizes * self.v.scores[self.v.bytes_at[0]]
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        piece, back = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
        base, check, value, scores = self.v.base, self.v.check, self.v.value, self.v.scores
        for i in range(width):
            rows = np.arange(np.searchsorted(lengths, i, "right"), n)
            here = best[i, rows]
            score = here + as_bytes[i, rows]
            better = score > best[i + 1, rows]
            at = rows[better]
            best[i + 1, at], piece[i + 1, at], back[i + 1, at] = score[better], -1, i
            nodes = np.zeros(len(rows), np.int32)
            for j in range(i, i + longest):
                c = grid[j, rows]
                after = base[nodes] + c
                goes = (check[after] == nodes) & (c > 0)
                rows, nodes, here = rows[goes], after[goes], here[goes]
                if not len(rows):
                    break
                ids = value[nodes]
                score = here + scores[ids]
                better = (ids >= 0) & (score > best[j + 1, rows])
                at = rows[better]
                best[j + 1, at], piece[j + 1, at], back[j + 1, at] = score[better], ids[better], i
        return self.paths(chunks, lengths, piece, back)

    def paths(self, chunks: list[str], ends: np.ndarray, piece: np.ndarray, back: np.ndarray) -> dict[str, bytes]:
        """Follow all best paths from their ends at once; those with bytes in them are written one by one."""
        rows, at, steps = np.arange(len(chunks)), ends.copy(), []
        count, spelled = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), bool)
        while len(rows):
            ids = piece[at, rows]
            spelled[rows[ids < 0]] = True
            steps.append((rows, ids))
            count[rows] += 1
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for step, (rows, ids) in enumerate(steps, 1):
            flat[start[rows] + count[rows] - step] = ids
        raw, start, count = flat.tobytes(), (4 * start).tolist(), (4 * count).tolist()
        out = {c: raw[a : a + n] for c, a, n in zip(chunks, start, count, strict=True)}
        for n in np.flatnonzero(spelled):
            out[chunks[n]] = self.path(chunks[n], int(ends[n]), piece[:, n].tolist(), back[:, n].tolist())
        return out

    def long(self, chunk: str) -> bytes:
        """The same for one chunk of any length."""
        n, worst = len(chunk), float("-inf")
        letters, sizes = (x.tolist() for x in self.letters(chunk))
        best, piece, back = [worst] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, bytes_at = self.lists()
        for i in range(n):
            here = best[i]
            score = here + sizes[i] * bytes_at
            if score > best[i + 1]:
                best[i + 1], piece[i + 1], back[i + 1] = score, -1, i
            node = 0
            for j in range(i, min(n, i + self.v.longest)):
                after = base[node] + letters[j]
                if not letters[j] or check[after] != node:
                    break
                node = after
                found = value[node]
                if found >= 0 and (score := here + scores[found]) > best[j + 1]:
                    best[j + 1], piece[j + 1], back[j + 1] = score, found, i
        return self.path(chunk, n, piece, back)

    def lists(self) -> tuple[list, list, list, list, float]:
        if not hasattr(self, "_lists"):
            v = self.v
            self._lists = (v.base.tolist(), v.check.tolist(), v.value.tolist(), v.scores.tolist(), float(v.scores[v.bytes_at[0]]))
        return self._lists

    def path(self, chunk: str, end: int, piece: list[int], back: list[int]) -> bytes:
        ids: list[int] = []
        while end:
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(int(self.v.bytes_at[b]) for b in reversed(chunk[end - 1].encode("utf-8", "surrogatepass")))
            end = back[end]
        return np.array(ids[::-1], np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: bytes joined, markers as blanks, the first one left out. Broken UTF-8 is replaced."""
        raw = b"".join(map(self.written.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def shipped(spark: SparkSession, vocabulary: Vocabulary):
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ``pieces`` (array of ids), and with ``verify`` also ``restored``: whether decoding gives the text again.

    All rows and columns are kept; a column of that name makes the new one's longer by ``_``. Null and empty texts have no
    pieces, and are restored as empty.
    """
    sent, column = shipped(docs.sparkSession, vocabulary), docs.columns.index(text)
    names = [fresh(docs, "pieces")] + [fresh(docs, "restored")] * verify
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names[0]}` array<int>"] + [f"`{n}` boolean" for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for whole in batches:
            for batch in sliced(whole, column):
                texts = batch.column(column).to_pylist()
                ids = codec.encode(texts)
                offsets = np.cumsum([0] + [len(x) for x in ids], dtype=np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
                if verify:
                    more.append(pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return map_batches(docs, run, schema)


def sliced(batch: pa.RecordBatch, column: int, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with texts of at most ``most_bytes``, or one text."""
    sizes = [0 if not x.is_valid else len(x.as_buffer()) for x in batch.column(column)]
    start = total = 0
    for n, size in enumerate(sizes):
        if total and total + size > most_bytes:
            yield batch.slice(start, n - start)
            start, total = n, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """``encoded`` with the texts of its ``pieces`` in a new column ``text`` (longer by ``_`` if taken). Null ids give null."""
    sent, column = shipped(encoded.sparkSession, vocabulary), encoded.columns.index(pieces)
    name = fresh(encoded, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + [f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            texts = [codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return map_batches(encoded, run, schema)
