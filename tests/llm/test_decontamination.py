import random

import pytest

from tests.llm.rows import documents, empty, same
from tranche.llm import decontamination as dc

ITEM = "A farmer has seventeen sheep and all but nine of them run away in the night. How many sheep are left?"
OTHER = "The capital of a country is not always its largest city, as the examples show."


def brute(item, text):
    """Least edit distance of the item to any substring."""
    row = [0] * (len(text) + 1)
    for n, a in enumerate(item, 1):
        new = [n]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def edited(text, n, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["q"], [out[at], "z"]])
    return "".join(out)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert dc.myers(item, text) == brute(item, text) if text else dc.myers(item, text)[0] == len(item)


def test_pieces_cover_the_item():
    for edits in (0, 1, 5, 500):
        cut = dc.pieces(ITEM, edits)
        assert "".join(p for _, p in cut) == ITEM and len(cut) == min(edits + 1, len(ITEM))
        assert all(ITEM[a:].startswith(p) for a, p in cut)


def rows():
    out = [(n, "before " * 40 + edited(ITEM, n, n) + " after" * 30) for n in range(9)]
    out += [(20, ITEM.upper()), (21, ITEM.replace(" ", " \n\t ")), (22, f"{OTHER} {ITEM} {OTHER}"), (23, ITEM[: len(ITEM) // 2])]
    return out + [(24, None), (25, ""), (None, OTHER), (22, f"{OTHER} {ITEM} {OTHER}")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (6, OTHER)], "item_id long, text string")


def expected():
    out = []
    for i, text in rows():
        for item, words in ((1, ITEM), (2, OTHER), (6, OTHER)):
            distance, end = brute(dc.normal(words), dc.normal(text)) if text else (len(words), 0)
            if distance <= dc.budget(len(dc.normal(words)), 0.05):
                out.append((i, item, distance, end))
    return out


@pytest.mark.parametrize("block_chars", [dc.BLOCK_CHARS, 60])
def test_matches_are_those_of_brute_force(spark, benchmark, block_chars):
    found = dc.contaminated(documents(spark, rows()), benchmark, block_chars=block_chars).collect()
    same([(r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in found], expected())


def test_clean_keeps_the_other_rows(spark, benchmark):
    docs = documents(spark, rows())
    kept = dc.clean(docs, benchmark)
    bad = {i for i, *_ in expected()}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows() if i not in bad)


def test_empty_tables(spark, benchmark):
    docs = documents(spark, rows())
    assert dc.contaminated(empty(spark), benchmark).count() == 0
    assert dc.contaminated(docs, benchmark.limit(0)).count() == 0
    assert dc.clean(docs, benchmark.limit(0)).count() == len(rows())
