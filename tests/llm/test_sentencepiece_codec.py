import random

import numpy as np
import pytest

from tests.llm.rows import TEXTS, documents, empty
from tranche.llm import sentencepiece_codec as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load(sp.public_model())


def toy():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *"▁ a b c d ab bc abc ▁a ▁ab ▁▁ cab".split()]
    normal = list(range(257, len(pieces)))
    scores = np.full(len(pieces), -np.inf)
    scores[normal] = [-1 - 0.37 * (n * 7 % 11) for n in range(len(normal))]
    scores[1:257] = scores[normal].min() - sp.BYTE_PENALTY
    return sp.build(pieces, scores, np.arange(1, 257, dtype=np.int32), normal)


def best_score(v, text):
    """Best score of the whole marked text by trying all pieces at all places, without chunks or trie."""
    marked = " " + text
    ids = {p: i for i, p in enumerate(v.pieces) if np.isfinite(v.scores[i]) and not p.startswith("<0x")}
    shown = "".join("" if c == sp.MARK else sp.MARK if c == " " else c for c in marked)
    best = [0.0] + [-np.inf] * len(shown)
    for i, c in enumerate(marked):
        best[i + 1] = max(best[i + 1], best[i] + v.scores[v.bytes_at[0]] * len(c.encode()))
        for j in range(i + 1, min(len(shown), i + v.longest) + 1):
            if shown[i:j] in ids:
                best[j] = max(best[j], best[i] + v.scores[ids[shown[i:j]]])
    return best[-1]


def test_segmentations_are_the_best(vocabulary):
    rng = random.Random(4)
    for v, letters in ((toy(), "abcd  x▁é\n"), (vocabulary, "aeinrsth  .,é日\n")):
        codec = sp.Codec(v)
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(150)]
        texts += ["", " ", "   ", "a" * 300, "ab" * 100 + " c"]
        for text, ids in zip(texts, codec.encode(texts), strict=True):
            assert codec.decode(ids) == text
            spelled = [i for i in ids.tolist()]
            total = sum(v.scores[i] for i in spelled)
            assert not text and not spelled or abs(total - best_score(v, text)) < 1e-6, text


def test_long_chunks_are_segmented_alike(vocabulary):
    codec = sp.Codec(vocabulary)
    for chunk in (" understanding", " naïve日本", " x\ny"):
        assert codec.long(chunk) == codec.segment([chunk])[chunk]


def test_pieces_across_words_are_refused():
    with pytest.raises(ValueError):
        sp.build(["a▁b"], np.zeros(1), np.zeros(256, np.int32), [0])


def test_round_trip_of_awkward_rows(spark, vocabulary):
    docs = documents(spark)
    found = sp.encode(docs, vocabulary, verify=True)
    assert found.columns == [*docs.columns, "pieces_", "restored"]
    rows = found.collect()
    assert len(rows) == len(TEXTS) and all(r["restored"] for r in rows)
    back = sp.decode(found, vocabulary, pieces="pieces_")
    assert all((r["text"] or "") == r["text_"] for r in back.collect())
    assert sp.encode(empty(spark), vocabulary).count() == 0
