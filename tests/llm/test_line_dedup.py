from collections import defaultdict

import pytest

from tests.llm.rows import TEXTS, documents, empty, same
from tranche.llm import line_dedup


def brute(rows, sites):
    """``rows``: (doc_id, text, site). Every row's text without later copies of lines on so many sites."""
    on, first = defaultdict(set), {}
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    for i, text, site in rows:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            norm = line.strip(" \t\r")
            if norm:
                on[norm] |= {site} - {None}
                first[norm] = min(first.get(norm, (i, place)), (i, place), key=order)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        stays = [not n or len(on[n]) < sites or first[n] == (i, p) for p, n in enumerate(x.strip(" \t\r") for x in lines)]
        out.append((i, "\n".join(x for x, s in zip(lines, stays, strict=True) if s), len(lines), stays.count(False)))
    return out


def spread():
    """Lines on one to thirty sites, so also around the threshold, and one that is in most rows."""
    rows = []
    for n in range(90):
        lines = [f"line of {k} sites" for k in range(1, 31) if n % 30 < k]
        rows.append((n, "\n".join(["own text %d" % n, *lines, "  Menu \t", "", "Menu"]), f"site{n % 30}"))
    return rows + [(90, None, "site1"), (91, "", "site2"), (92, "Menu", None), (0, rows[0][1], "site0")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], "doc_id long, text string, source string, k1 string, gone int, place int")


@pytest.mark.parametrize("sites", [10, 28])
def test_spread_lines_stay_at_their_first_place(spark, sites):
    found = line_dedup.dedup(frame(spark, spread()), sites=sites, counts=True)
    assert found.columns == ["doc_id", "text", "source", "k1", "gone", "place", "n_lines", "n_removed"]
    same([(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()], brute(spread(), sites))


def test_awkward_rows_and_empty_table(spark):
    docs = documents(spark, TEXTS)
    found = line_dedup.dedup(docs, sites=2)
    assert found.columns == docs.columns
    sites = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    same([(r["doc_id"], r["text"]) for r in found.collect()], [r[:2] for r in brute(sites, 2)])
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_no_python_runs(spark):
    plan = line_dedup.dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_lines_have_a_lower_threshold(spark):
    passage = lambda n, size: " ".join(f"p{n}w{i}" for i in range(size))
    rows = []
    for n in range(12):
        lines = [f"own {n}", *[passage(k, size) for k, size in ((2, 51), (3, 51), (4, 50), (9, 60), (11, 30)) if n < k]]
        rows.append((n, "\n".join(lines), f"site{n}"))
    rows += [(100 + n, f"alone {n}\n" + passage(50, 80), "site0") for n in range(30)]  # one site
    rows += [(200 + n, "copied\n" + passage(60, 80), f"site{n}") for n in range(5)]  # copies of one document
    found = line_dedup.dedup(frame(spark, rows), counts=True, long_sites=3)
    got = {r["doc_id"]: r for r in found.collect()}
    gone = {3: 3, 9: 9, 11: 11}  # passages on too many sites, by the number of those
    for n, text, _ in rows[:12]:
        kept = [x for x in text.split("\n") if n == 0 or not any(x.startswith(f"p{k}w0 ") for k in gone)]
        assert got[n]["text"] == "\n".join(kept)
    assert all(r["n_removed"] == 0 for i, r in got.items() if i >= 100)
    whole = line_dedup.dedup(frame(spark, rows), counts=True)
    assert sum(r["n_removed"] for r in whole.collect()) == 10


def test_pipeline_takes_passages_on_few_sites(spark):
    import corpus_pipeline

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(n, f"own {n}\n{passage}", f"site{n}") for n in range(4)]
    kept = corpus_pipeline.without_boilerplate(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {0: rows[0][1], 1: "own 1", 2: "own 2", 3: "own 3"}
