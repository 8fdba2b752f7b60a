"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, linked where their byte ranges overlap.

Texts are cut at spaces that neither tokenizer's tokens reach across (``cuts_apart`` checks the vocabularies; others are not
cut). The parts of a batch not seen before are encoded by both tokenizers; every token gets its byte range. One ``pandas.merge_asof`` per
direction, keyed by document, finds for each token start the other side's token that covers it (the one with the
largest start at or before it). Two ranges overlap exactly when one's start lies in the other, so the union of both
directions is every overlapping pair. Offsets where both sides end a token cut the tokens into groups. A part ends a
token on both sides, so a document's groups and links are those of its parts together. Aligned parts are remembered up
to a bound.

Corpus-wide, each (A id, B id) pair is counted once per document that links it, by one grouped aggregation that
combines map-side, so a pair in every document costs one row per task before the shuffle. The counts go back to the
documents' links by a join: broadcast when the number of distinct pairs is within ``BROADCAST_PAIRS`` (counted first),
else by a join whose pair side is copied to ``SALTS`` salts so that a frequent pair is spread over as many tasks.

Nulls and edge cases: a null or empty text, or one whose token bytes don't join to ``" " + text`` on either side (a
tokenizer that changes the text), has no tokens: all counts 0, groups ``''``. Repeated rows count as documents each.
Extra columns are kept; clashing names are lengthened.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tranche.llm.bpe import load as load_bpe
from tranche.llm.common import fresh, map_batches, shared_folder, written_once

#: Distinct (A id, B id) pairs that may be broadcast to the tasks; more go through a salted shuffle join.
BROADCAST_PAIRS = 2_000_000
#: Copies of the pair counts in the salted join, so that a pair linked in most documents is split this many ways.
SALTS = 16
MARK = "▁"
#: Text bytes aligned at once in a task: tokens, links and group texts of a slice are held together.
SLICE_BYTES = 1 << 18

#: Aligned parts of texts remembered by a task from slice to slice, and the longest that is, in characters. When there are more,
#: those not used again are forgotten.
REMEMBERED, LONGEST = 200_000, 100
#: A space behind a character that is none, and before any other.
GAP = re.compile(r"(?<=\S) (?!\Z)")
SPACED = re.compile(r"\s ")

LINK = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.IntegerType(), False), T.StructField("n", T.LongType(), False)])
ALIGNED = [
    ("n_a", T.LongType()),
    ("n_b", T.LongType()),
    ("n_groups", T.LongType()),
    ("n_links", T.LongType()),
    ("groups", T.StringType()),
    ("links", T.ArrayType(LINK, False)),
]


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: UTF-8 with the marker as a space, and ``<0xHH>`` as the byte HH."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(MARK, " ").encode("utf-8")


def flat_bytes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes one after another, and where each piece starts."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])[:-1].astype(np.int64)


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All lists' ids one after another, and their number per list."""
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def joined(ids: np.ndarray, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of ``ids`` joined, gathered from the flat table."""
    sizes = lengths[ids]
    places = np.arange(int(sizes.sum())) + np.repeat(at[ids] - (np.cumsum(sizes) - sizes), sizes)
    return flat[places]


class Sides:
    """Both tokenizers with the byte length of each of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        # One thread a task: Spark gives each task its core, and a thread pool's memory arenas outlive the batches.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_bytes = load_bpe(a_path).token_bytes
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_flat, self.a_at = flat_bytes(self.a_bytes)
        self.b_flat, self.b_at = flat_bytes(self.b_bytes)
        self.cuts = cuts_apart(a_path, self.b)
        if max(len(self.a_len), len(self.b_len)) > 1 << 16:
            raise ValueError("ids are packed in 16 bits: vocabularies of at most 65,536 ids")

    def flat_tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, those of all texts one after another, with their number per text: A ids, numbers, B ids, numbers.

        None where the text is null or empty or a side's bytes differ from ``" " + text``.
        """
        present = [t for t in texts if t]
        wholes = [(" " + t).encode("utf-8") for t in present]
        sizes = np.array([len(w) for w in wholes], np.int64)
        a_ids, a_counts = self.a_tokens(present, sizes)
        b_lists = self.b.encode(present, num_threads=1) if present else []
        fits = np.ones(len(present), bool)
        sides = []
        tables = (self.a_len, self.a_flat, self.a_at), (self.b_len, self.b_flat, self.b_at)
        for (ids, counts), (lengths, flat, at) in zip(((a_ids, a_counts), flat_lists(b_lists)), tables):
            of = np.repeat(np.arange(len(present)), counts)
            # Lengths are whole numbers far below 2**53, so the sums are exact.
            same = np.bincount(of, lengths[ids], len(present)) == sizes
            text = np.frombuffer(b"".join(w for w, k in zip(wholes, same.tolist()) if k), np.uint8)
            wrong = joined(ids[same[of]], flat, at, lengths) != text
            same[np.repeat(np.flatnonzero(same), sizes[same])[wrong]] = False
            fits &= same
            sides.append((ids, counts, of))
        out = []
        filled = np.flatnonzero([bool(t) for t in texts])
        for ids, counts, of in sides:
            every = np.zeros(len(texts), np.int64)
            every[filled] = np.where(fits, counts, 0)
            out += [ids[fits[of]], every]
        return tuple(out)

    def a_tokens(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all texts, and their number per text. Texts that ``cuts`` allows it for are encoded as one, joined again."""
        # The fast form leaves out character offsets; the ids are the same.
        encode = lambda found: [e.ids for e in self.a.encode_batch_fast(found, add_special_tokens=False)]
        if self.cuts and texts and not any(t[-1].isspace() for t in texts[:-1]):
            ids = np.array(encode([" " + " ".join(texts)])[0], np.int64)
            ends, text_ends = np.cumsum(self.a_len[ids]), np.cumsum(sizes)
            last = np.searchsorted(ends, text_ends)
            if len(ends) and ends[-1] == text_ends[-1] and np.array_equal(ends[last], text_ends):
                return ids, np.diff(last, prepend=-1)
        return flat_lists(encode([" " + t for t in texts]))

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; empty where the text is null or empty or a side's bytes differ from ``" " + text``."""
        a, n_a, b, n_b = self.flat_tokens(texts)
        return list(zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]))) if texts else []


def cuts_apart(a_path: str, b) -> bool:
    """Whether texts may be cut at spaces between other characters (``GAP``) without changing a token of either side.

    A: byte-level BPE whose pattern lets a piece take one space before it, with no other change of the text and special
    added tokens only (they are plain text here). B: BPE by merges, the text taken as it is behind one space, bytes for
    unknown characters, and no piece that holds a space behind another character.
    """
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    cutter = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type", "BPE") == "BPE" and not spec.get("normalizer") and all(t.get("special") for t in spec.get("added_tokens", []))
    if not plain or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return False
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto.FromString(b.serialized_model_proto())
    trainer, normal, kinds = model.trainer_spec, model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    return (
        trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        and not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        and all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) and MARK not in p.piece.lstrip(MARK) for p in model.pieces)
    )


def side_frame(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, name: str) -> pd.DataFrame:
    """Tokens of a batch: document, global start and end (documents laid one after another), id, place in the batch."""
    ends = np.cumsum(lengths[ids])
    docs = np.repeat(np.arange(len(counts)), counts)
    return pd.DataFrame({"doc": docs, "start": ends - lengths[ids], "end": ends, name: ids, f"{name}_at": np.arange(len(ids))})


_DECIMAL = np.array([str(i) for i in range(1 << 16)], dtype=object)


def decimal(ids: np.ndarray) -> np.ndarray:
    """Decimal text of ids below 65,536, as Python strings."""
    return _DECIMAL[ids]


def align_batch(pairs: list[tuple[np.ndarray, np.ndarray]], a_len: np.ndarray, b_len: np.ndarray) -> dict:
    """``align_flat`` of the ids of both sides per document."""
    flat = []
    for side in (0, 1):
        ids = [p[side] for p in pairs]
        flat += [np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array([len(x) for x in ids], np.int64)]
    return align_flat(*flat, a_len, b_len)


def align_flat(a_ids: np.ndarray, a_counts: np.ndarray, b_ids: np.ndarray, b_counts: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> dict:
    """Columns per document: n_a, n_b, n_groups, n_links, groups text; links as (offsets, a, b, n), distinct per document.

    Ids of all documents follow one another, with their number per document beside them.
    """
    a = side_frame(a_ids, a_counts, a_len, "a")
    b = side_frame(b_ids, b_counts, b_len, "b")
    # Both sides tile the same bytes in the same order, so their global offsets agree document by document.
    by_a = pd.merge_asof(a[["start", "doc", "a"]], b[["start", "doc", "b"]], on="start", by="doc", direction="backward")
    by_b = pd.merge_asof(
        b[["start", "doc", "b"]], a[["start", "doc", "a"]].assign(a_start=a["start"]), on="start", by="doc", direction="backward"
    )
    # A pair found from both sides starts at one place on both; from B's side it is taken only where the starts differ.
    by_b = by_b[by_b["a_start"].to_numpy() != by_b["start"].to_numpy()]
    docs = len(a_counts)
    link_doc = np.concatenate([by_a["doc"].to_numpy(), by_b["doc"].to_numpy()]).astype(np.int64)
    key = (link_doc << 32) | (np.concatenate([by_a["a"].to_numpy(), by_b["a"].to_numpy()]).astype(np.int64) << 16)
    key |= np.concatenate([by_a["b"].to_numpy(), by_b["b"].to_numpy()]).astype(np.int64)
    distinct, n = np.unique(key, return_counts=True)
    a_doc, b_doc = a["doc"].to_numpy(), b["doc"].to_numpy()
    # Both sides' ends are in order: common ones are found by halving, without hashing or sorting them.
    a_ends, b_ends = a["end"].to_numpy(), b["end"].to_numpy()
    cuts = a_ends[np.searchsorted(b_ends, a_ends, "right") > np.searchsorted(b_ends, a_ends)]
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])] if len(cuts) else cuts
    a_group = np.searchsorted(cuts, a_ends)
    b_group = np.searchsorted(cuts, b_ends)
    # Groups text: every token with the sign after it; A tokens of a group before its B tokens, groups in order.
    a_last = np.append(a_group[1:] != a_group[:-1], True) if len(a_group) else np.zeros(0, bool)
    b_last = np.append(b_group[1:] != b_group[:-1], True) if len(b_group) else np.zeros(0, bool)
    b_end = np.append(b_doc[1:] != b_doc[:-1], True) if len(b_doc) else np.zeros(0, bool)
    a_sign = np.where(a_last, "|", ",").astype(object)
    b_sign = np.where(b_end, "", np.where(b_last, ";", ",")).astype(object)
    # Two sorted runs: a stable sort merges them, A tokens of a group before its B tokens.
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    numbers = np.concatenate([decimal(a["a"].to_numpy()), decimal(b["b"].to_numpy())])[order]
    signs = np.empty(2 * len(order), dtype=object)
    signs[0::2], signs[1::2] = numbers, np.concatenate([a_sign, b_sign])[order]
    place = 2 * np.searchsorted(np.concatenate([a_doc, b_doc])[order], np.arange(docs + 1))
    signs = signs.tolist()
    groups_text = ["".join(signs[place[d] : place[d + 1]]) for d in range(docs)]
    n_a = np.bincount(a_doc, minlength=docs)
    n_b = np.bincount(b_doc, minlength=docs)
    n_groups = np.bincount(b_doc[b_last], minlength=docs) if len(b_doc) else np.zeros(docs, np.int64)
    n_links = np.bincount(link_doc, minlength=docs)
    offsets = np.searchsorted(distinct >> 32, np.arange(docs + 1))
    counted = {"a": (distinct >> 16) & 0xFFFF, "b": distinct & 0xFFFF, "n": n}
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups_text,
        "links": (offsets, counted["a"], counted["b"], counted["n"]),
    }


def parts_of(text: str) -> list[str]:
    """``text`` cut at every gap; the space there belongs to no part."""
    if text[0] == " " or text[-1] == " " or SPACED.search(text):
        return GAP.split(text)
    return text.split(" ")  # the same, and faster


class Places(dict):
    """Places of parts; a part looked up for the first time takes the next one."""

    def __missing__(self, part: str) -> int:
        place = self[part] = len(self)
        return place


class Aligner:
    """Aligns texts slice by slice; parts between gaps are aligned once and then remembered."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.sides = Sides(a_path, b_path)
        self.forget()

    def forget(self) -> None:
        #: Places of the remembered parts in the columns below; ``link_at`` has one place more than there are parts.
        self.known = Places()
        self.numbers = np.zeros((4, 0), np.int64)
        self.groups: list[str] = []
        self.link_at = np.zeros(1, np.int64)
        self.links = np.zeros((2, 0), np.int64)
        #: Slices that used a part again, since parts were last forgotten.
        self.uses = np.zeros(0, np.int64)

    def keep(self, size: int) -> None:
        """Cut the columns to their first ``size`` parts."""
        self.numbers, self.groups, self.link_at = self.numbers[:, :size], self.groups[:size], self.link_at[: size + 1]
        self.links, self.uses = self.links[:, : self.link_at[-1]], self.uses[:size]

    def forget_unused(self) -> None:
        """Of more than ``REMEMBERED`` parts keep those used again, the most used half of ``REMEMBERED`` at most."""
        kept = np.flatnonzero(self.uses)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: REMEMBERED // 2]])
        parts = list(self.known)
        self.known = Places(zip(map(parts.__getitem__, kept.tolist()), range(len(kept))))
        places, sizes = self.link_places(kept)
        self.numbers, self.links = self.numbers[:, kept], self.links[:, places]
        self.groups = list(map(self.groups.__getitem__, kept.tolist()))
        self.link_at = np.append(0, np.cumsum(sizes))
        self.uses = np.zeros(len(kept), np.int64)

    def link_places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``links`` of the parts at ``at``, one part after another, and their number per part."""
        sizes = np.diff(self.link_at)[at]
        return np.arange(int(sizes.sum())) + np.repeat(self.link_at[at] - (np.cumsum(sizes) - sizes), sizes), sizes

    def add(self, runs: list[list[str]]) -> None:
        found = [align_flat(*self.sides.flat_tokens(parts), self.sides.a_len, self.sides.b_len) for parts in runs if parts]
        self.numbers = np.concatenate([self.numbers, *[[f[n] for n in ("n_a", "n_b", "n_groups", "n_links")] for f in found]], axis=1)
        ends = [self.link_at]
        for f in found:
            ends.append(f["links"][0][1:] + ends[-1][-1])
            self.groups += f["groups"]
        self.link_at = np.concatenate(ends)
        self.links = np.concatenate([self.links, *[[f["links"][1] << 16 | f["links"][2], f["links"][3]] for f in found]], axis=1)

    def align(self, texts: list[str | None]) -> dict:
        """The columns of ``align_flat``, a row per text."""
        try:
            return self.aligned(texts)
        except BaseException:
            # A worker serves later tasks too: parts that have a place, but no columns yet, must not stay.
            self.forget()
            raise

    def aligned(self, texts: list[str | None]) -> dict:
        cut = [(parts_of(t) if self.sides.cuts else [t]) if t else [] for t in texts]
        counts = np.array([len(parts) for parts in cut], np.int64)
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        new = list(islice(reversed(self.known), len(self.known) - before))[::-1]
        # Those that end in a space character can't be joined with others; long ones are not remembered beyond their slice.
        joinable, ending, long = [], [], []
        for p in new:
            (long if len(p) > LONGEST else ending if p[-1:].isspace() else joinable).append(p)
        if ending or long:
            # The columns have the parts in this order.
            place = np.arange(len(self.known))
            for i, p in enumerate(chain(joinable, ending, long), before):
                place[self.known[p]] = i
            at = place[at]
            for p in new:
                del self.known[p]
            self.known.update(zip(chain(joinable, ending, long), range(before, before + len(new))))
        if new:
            self.add([joinable, ending, long])
        out = self.composed(counts, at)
        self.keep(len(self.groups) - len(long))
        for p in long:
            del self.known[p]
        again = np.bincount(at[at < before], minlength=before) > 0
        self.uses = np.append(self.uses + again, np.zeros(len(self.groups) - before, np.int64))
        if len(self.known) > REMEMBERED:
            self.forget_unused()
        return out

    def composed(self, counts: np.ndarray, at: np.ndarray) -> dict:
        """The columns of texts of ``counts`` parts each, whose places are ``at``."""
        docs = len(counts)
        doc = np.repeat(np.arange(docs), counts)
        # A part without tokens is one that a tokenizer changes: then the whole text has none.
        changed = np.zeros(docs, bool)
        changed[doc[self.numbers[0, at] == 0]] = True
        if changed.any():
            kept = ~changed[doc]
            at, doc = at[kept], doc[kept]
        # Sums of whole numbers far below 2**53 are exact.
        sums = [np.bincount(doc, row[at], docs).astype(np.int64) for row in self.numbers]
        place = np.searchsorted(doc, np.arange(docs + 1)).tolist()
        groups = list(map(self.groups.__getitem__, at.tolist()))
        links, sizes = self.link_places(at)
        key = np.repeat(doc, sizes) << 32 | self.links[0, links]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(self.links[1, links][order], first) if len(key) else first
        key = key[first]
        return {
            "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3],
            "groups": [";".join(groups[place[d] : place[d + 1]]) for d in range(docs)],
            "links": (np.searchsorted(key >> 32, np.arange(docs + 1)), (key >> 16) & 0xFFFF, key & 0xFFFF, n),
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per pair of vocabularies in a Python worker, which Spark reuses across tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[(a_path, b_path)] = Aligner(a_path, b_path)
    return _ALIGNERS[(a_path, b_path)]


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose texts hold at most ``SLICE_BYTES`` together; a longer text is a slice alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes) or not len(sizes):
        yield batch.slice(start)


def aligned(df: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``n_a, n_b, n_groups, n_links, groups`` and ``links`` (distinct (a, b) of the document with n occurrences)."""
    a_path, b_path = (a_path, b_path) if a_path and b_path else public_paths()
    names = [fresh(df, n) for n, _ in ALIGNED]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t, False) for n, (_, t) in zip(names, ALIGNED)]])
    at = df.columns.index(text)
    link = pa.struct([pa.field("a", pa.int32(), False), pa.field("b", pa.int32(), False), pa.field("n", pa.int64(), False)])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.field("item", link, False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_path, b_path)
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = aligner.align(batch.column(at).to_pylist())
            offsets, la, lb, ln = found["links"]
            items = pa.StructArray.from_arrays([pa.array(la, pa.int32()), pa.array(lb, pa.int32()), pa.array(ln, pa.int64())], fields=list(link))
            columns = [pa.array(np.asarray(found[n], np.int64), pa.int64()) for n, _ in ALIGNED[:4]]
            columns += [pa.array(found["groups"], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=types[5])]
            fields = [*batch.schema, *[pa.field(n, t, False) for n, t in zip(names, types)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema(fields))

    return map_batches(df, run, schema)


def report(
    df: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", instead: dict[str, Column] | None = None
) -> DataFrame:
    """Every row of ``df`` with its alignment and ``n_best`` and ``count_sum`` from the corpus-wide pair counts.

    A pair's count is the number of rows that link it; a link is best where its pair's count is the highest of its A id.
    ``instead``: columns made of the aligned ones that stand for the text, groups and links in the result, so that the
    last join shuffles those (a digest, say) and not the long columns they are made of.
    """
    row, found = fresh(df, "row"), fresh(df, "links")
    # Written once, zstd-compressed (the groups are long digit texts), so row ids hold and the Python pass runs once.
    place = shared_folder(df.sparkSession, "alignment")
    result = aligned(df, a_path, b_path, text).withColumn(row, F.monotonically_increasing_id())
    result.write.option("compression", "zstd").parquet(place)
    done = df.sparkSession.read.schema(result.schema).parquet(place)
    links = done.select(row, F.explode(found).alias("l")).select(row, "l.a", "l.b", "l.n")
    counts = links.groupBy("a", "b").agg(F.count("*").alias("count"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    pairs = written_once(counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")), "alignment-pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        joined = links.join(F.broadcast(pairs), ["a", "b"])
    else:
        salt = F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")
        copies = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = links.withColumn("salt", salt).join(copies, ["a", "b", "salt"])
    per_row = joined.groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
    n_best, count_sum = fresh(done, "n_best"), fresh(done, "count_sum")
    per_row = per_row.withColumnsRenamed({"n_best": n_best, "count_sum": count_sum})
    if instead:
        groups = fresh(df, "groups")
        done = done.withColumns(instead).drop(*[c for c in (text, groups, found) if c not in instead])
    out = done.join(per_row, row, "left").withColumns({n_best: F.coalesce(n_best, F.lit(0)), count_sum: F.coalesce(count_sum, F.lit(0))})
    return out.drop(row)
