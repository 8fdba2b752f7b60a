import bisect
from collections import Counter

import numpy as np
import pytest

from tests.llm.rows import TEXTS, documents, empty
from tranche.llm import alignment as al


@pytest.fixture(scope="module")
def sides():
    return al.Sides(*al.public_paths())


def brute(sides, a, b):
    """Links by comparing every A token with every B token; groups by walking the common ends."""
    ae = np.cumsum(sides.a_len[a])
    be = np.cumsum(sides.b_len[b])
    as_, bs = ae - sides.a_len[a], be - sides.b_len[b]
    links = Counter((int(a[i]), int(b[j])) for i in range(len(a)) for j in range(len(b)) if as_[i] < be[j] and bs[j] < ae[i])
    cuts = sorted(set(ae.tolist()) & set(be.tolist()))
    ga = [bisect.bisect_left(cuts, e) for e in ae]
    gb = [bisect.bisect_left(cuts, e) for e in be]
    groups = [",".join(str(a[i]) for i in range(len(a)) if ga[i] == g) + "|" + ",".join(str(b[j]) for j in range(len(b)) if gb[j] == g) for g in range(len(cuts))]
    return links, ";".join(groups)


WORDS = ["the", "cat", "über", "naïve", "日本", "😀", "  ", "\n", "\t", "<s>", "<|endoftext|>", "x-ray", "1234567", "don't"]


def test_batch_equals_brute_force(sides):
    rng = np.random.default_rng(3)
    texts = [t for _, t in TEXTS if t is None or len(t) < 2000] + ["".join(rng.choice(WORDS, 40)) for _ in range(30)] + [" ".join(rng.choice(WORDS, 60)) for _ in range(30)]
    found = al.align_batch(sides.tokens(texts), sides.a_len, sides.b_len)
    off, la, lb, ln = found["links"]
    for k, (a, b) in enumerate(sides.tokens(texts)):
        links, groups = brute(sides, a, b)
        assert {(int(la[i]), int(lb[i])): int(ln[i]) for i in range(off[k], off[k + 1])} == links
        assert found["groups"][k] == groups
        assert found["n_links"][k] == sum(links.values())
        assert (found["n_a"][k], found["n_b"][k], found["n_groups"][k]) == (len(a), len(b), groups.count(";") + 1 if groups else 0)


def test_parts_aligned_once_equal_whole_texts(sides, monkeypatch):
    """Texts cut at spaces, their parts remembered and forgotten, or not cut at all: the same columns as whole texts give."""
    rng = np.random.default_rng(4)
    gaps = [" ", " ", " ", "  ", "\n", " \n ", "\t ", "\x1f ", "\u3000 ", "\xa0", "'s ", ""]
    words = WORDS + ["a" * 150, "end.", "▁", "don", "'ll"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.integers(1, 30))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a ", " a", "▁ ▁", "a ▁ b", "a  b", "\n a"] + [t.replace("▁", "") + " end" for t in texts]
    want = al.align_batch([sides.tokens([t])[0] for t in texts], sides.a_len, sides.b_len)
    assert 0 < (want["n_a"] == 0).sum() < len(texts)

    def check(aligner, size):
        got = [aligner.align(texts[i : i + size]) for i in range(0, len(texts), size)]
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            assert np.array_equal(np.concatenate([g[name] for g in got]), want[name])
        assert [x for g in got for x in g["groups"]] == want["groups"]
        for k in (1, 2, 3):
            assert np.array_equal(np.concatenate([g["links"][k] for g in got]), want["links"][k])
        assert np.array_equal(np.concatenate([np.diff(g["links"][0]) for g in got]), np.diff(want["links"][0]))

    aligner = al.Aligner(*al.public_paths())
    assert aligner.sides.cuts
    for size in (len(texts), 7, 7):
        check(aligner, size)
    assert len(aligner.known) == len(aligner.groups) == aligner.numbers.shape[1] and not any(len(p) > al.LONGEST for p in aligner.known)
    monkeypatch.setattr(al, "REMEMBERED", 20)
    check(aligner, 3)
    aligner.sides.cuts = False
    aligner.forget()
    check(aligner, 50)


def test_parts_used_again_stay_when_others_are_forgotten(monkeypatch):
    """Of too many parts those of later slices stay, so they are not encoded again; a failed slice leaves nothing half known."""
    monkeypatch.setattr(al, "REMEMBERED", 20)
    aligner = al.Aligner(*al.public_paths())
    encoded = Counter()
    whole = aligner.sides.flat_tokens
    monkeypatch.setattr(aligner.sides, "flat_tokens", lambda parts: (encoded.update(parts), whole(parts))[1])
    for i in range(30):
        aligner.align([f"often {'x' * 120} rare{i} {' '.join(f'w{i}q{j}' for j in range(5))} cut\n"])
        assert len(aligner.known) == len(aligner.groups) == aligner.numbers.shape[1] == len(aligner.uses) <= 20
    assert encoded["often"] == encoded["cut\n"] == 1 and encoded["rare3"] == 1 and encoded["x" * 120] == 30
    want = aligner.align(["often seen", "often cut\n"])["groups"]
    monkeypatch.setattr(aligner.sides, "flat_tokens", lambda parts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        aligner.align(["often new"])
    monkeypatch.setattr(aligner.sides, "flat_tokens", whole)
    assert aligner.align(["often seen", "often cut\n"])["groups"] == want


def test_texts_without_tokens(sides):
    texts = [None, "", "a b"]  # the last: whether the piece side changes it or not, both sides must join to the text
    for (a, b), t in zip(sides.tokens(texts), texts):
        if not t:
            assert len(a) == len(b) == 0
        elif len(a):
            assert bytes(np.concatenate([sides.a_flat[sides.a_at[i] : sides.a_at[i] + sides.a_len[i]] for i in a])) == (" " + t).encode()


def test_report_counts_documents_corpus_wide(spark, sides):
    rows = [(1, "the cat"), (2, "the cat"), (3, "the dog"), (3, "the dog"), (4, None), (5, ""), (None, "cat")]
    docs = documents(spark, rows).withColumnRenamed("fp", "row").withColumnRenamed("pieces", "links")
    got = al.report(docs).collect()
    assert len(got) == len(rows) and "links_" in got[0].__fields__ and got[0]["links"] == "x"
    per_text = {}
    counts = Counter()
    for r in got:
        counts.update({(x.a, x.b) for x in r["links_"]})
    top = Counter()
    for (x, y), c in counts.items():
        top[x] = max(top[x], c)
    for r in got:
        assert r["count_sum"] == sum(x.n * counts[(x.a, x.b)] for x in r["links_"])
        assert r["n_best"] == sum(x.n for x in r["links_"] if counts[(x.a, x.b)] == top[x.a])
        per_text[r["text"]] = r
    assert per_text[None]["n_a"] == per_text[""]["n_links"] == per_text[None]["count_sum"] == 0
    assert per_text[None]["groups"] == ""
    assert al.report(empty(spark)).count() == 0


def test_salted_join_equals_broadcast(spark, monkeypatch):
    docs = documents(spark).where("length(text) < 1000")
    plain = sorted((r.doc_id, r.n_best, r.count_sum) for r in al.report(docs).collect() if r.doc_id is not None)
    monkeypatch.setattr(al, "BROADCAST_PAIRS", 0)
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in al.report(docs).collect() if r.doc_id is not None) == plain


def test_slices_cover_every_row_once(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 50]})
    monkeypatch.setattr(al, "SLICE_BYTES", 20)
    parts = list(al.slices(batch, 0))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert [p.num_rows for p in al.slices(batch.slice(0, 0), 0)] == [0]


def test_digests_travel_through_the_join_instead_of_the_texts(spark):
    from pyspark.sql import functions as F

    docs = documents(spark).select("doc_id", "text").where("length(text) < 1000 or text is null")
    narrow = al.report(docs, instead={"digest": F.sha2("groups", 256)})
    assert narrow.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "n_best", "count_sum"]
    whole = al.report(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.sha2("groups", 256).alias("digest"), "n_best", "count_sum")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, narrow.collect())) == sorted(map(key, whole.collect()))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :].splitlines()
    assert "sha2" in join[1]
