import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.rows import TEXTS, documents, empty
from tranche.llm import bpe

ODD = ["", " ", "aaaa", "aaaaa", "hello<|endoftext|>world", "<|endoftext|><|endoftext|>", "<|endoftext", "  \n\n  x", "日本語 😀😀", "don't  I'll", "a" * 3000, " " * 500 + "b", "\x00\x1f"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(bpe.public_vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_vocabulary())


def test_ids_equal_the_library(vocab, library):
    texts = [t for _, t in TEXTS if t is not None] + ODD
    mine = bpe.Encoder(vocab).encode_batch(texts)
    assert mine == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for ids in mine:
        assert bpe.decode_ids(ids, vocab) == library.decode(ids, skip_special_tokens=False)


def test_added_tokens_as_plain_text(vocab, library):
    library.encode_special_tokens = True
    texts = ["a<|endoftext|>b", "<|endoftext|>"]
    assert bpe.Encoder(vocab, split_added=False).encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    library.encode_special_tokens = False


def test_batches_and_memory_give_the_same_ids(vocab, monkeypatch):
    texts = ["the cat sat", "the cat sat on the mat", "mat mat mat"] * 3
    whole = bpe.Encoder(vocab).encode_batch(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    encoder = bpe.Encoder(vocab)
    assert [encoder.encode_batch([t])[0] for t in texts] == whole


def test_rank_order_within_a_piece(vocab):
    # repeated symbols merge from the left, as the lowest rank and leftmost place first
    assert bpe.merge_pieces([b"aaa", b"", b"aaaaa"], vocab) == bpe.merge_pieces([b"aaa"], vocab) + [[]] + bpe.merge_pieces([b"aaaaa"], vocab)


def test_pieces_merged_in_arrays_equal_those_merged_by_the_index(vocab, library, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["ing", "aaaa", "the", "ü", "日本", "  ", "\n", "9", "'", "qu", "\x1f"]
    pieces = ["".join(rng.choice(words, n)).encode() for n in range(40) for _ in range(6)]
    whole = bpe.merge_pieces(pieces, vocab)
    assert whole == bpe.merge_long(pieces, vocab) and {len(p) > max(bpe.WIDTHS) for p in pieces} == {True, False}
    monkeypatch.setattr(bpe, "BLOCK", 3)
    assert bpe.merge_pieces(pieces, vocab) == whole
    texts = ["".join(map(chr, rng.integers(0, 128, 200))) for _ in range(50)]  # every ASCII character, by the ASCII pattern
    assert bpe.Encoder(vocab).encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        bpe.decode_packed(np.array([10**7], "<u4").tobytes(), vocab)


def test_decode_refuses_unknown_ids(vocab):
    assert bpe.decode_ids(None, vocab) == ""
    with pytest.raises(ValueError):
        bpe.decode_ids([10**7], vocab)


def test_frame_round_trip_with_nulls_and_clashing_columns(spark, library):
    docs = documents(spark).withColumnRenamed("pieces", "ids")
    found = bpe.decode(bpe.encode(docs), ids="ids_").collect()
    assert "ids_" in found[0].asFieldNames() if hasattr(found[0], "asFieldNames") else "ids_" in found[0].__fields__
    for row in found:
        assert row["ids_"] == (library.encode(row["text"], add_special_tokens=False).ids if row["text"] else [])
        assert row["decoded"] == (row["text"] or "")
    assert bpe.encode(empty(spark)).count() == 0


def test_digest_is_of_little_endian_ids(spark):
    df = spark.createDataFrame([(1, [1, 256, 70000]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.ids_sha256 for r in bpe.ids_digest(df).collect()}
    assert got[1] == hashlib.sha256(np.array([1, 256, 70000], "<u4").tobytes()).hexdigest()
    assert got[2] == got[3] == hashlib.sha256(b"").hexdigest()


def test_round_trip_equals_the_three_steps(spark):
    docs = documents(spark).withColumnRenamed("pieces", "decoded")
    one = bpe.round_trip(docs).select("doc_id", "text", "ids", "ids_sha256", "decoded_").collect()
    three = bpe.ids_digest(bpe.decode(bpe.encode(docs), ids="ids", out="decoded_")).select("doc_id", "text", "ids", "ids_sha256", "decoded_").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, three))
