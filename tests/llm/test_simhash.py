from collections import defaultdict

import pytest
import xxhash

from tests.llm.rows import TEXTS, documents, empty, same
from tranche.llm import simhash


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens, token = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            tokens, token = tokens + [token] * bool(token), ""
        else:
            token += c
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=2):
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, a in enumerate(prints):
        for b in prints[n + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                root[find(b)] = find(a)
    ids = defaultdict(set)
    for i, p in rows:
        ids[find(p)].add(i)
    return [(i, p, min((x for x in ids[find(p)] if x is not None), default=None)) for i, p in rows]


def short(rows):
    return [(i, t) for i, t in rows if t is None or len(t) < 1000]


def test_fingerprint_is_that_of_brute_force():
    for _, text in short(TEXTS):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_a_long_text_does_not_depend_on_the_chunks(monkeypatch):
    whole = simhash.fingerprint(TEXTS[8][1])
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(TEXTS[8][1]) == whole


def test_fingerprints_use_the_hash_of_spark(spark):
    spark_hash = spark.sql("select xxhash64('one') as h").first()["h"]
    assert simhash.fingerprint("one") == spark_hash % 2**64


def test_groups_of_awkward_rows(spark):
    rows = short(TEXTS)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    expected = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    same([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got], expected)


def test_links_join_what_pairs_join(spark):
    # Chains, balls around an absent centre, and pairs just too far apart.
    prints = [0, 0b11, 0b1111, 0b111111, 1 << 63, (1 << 63) | 1, 0xFF << 20, (0xFF << 20) | 0b111, *(0xABCDEF << 8 | 1 << n for n in range(8))]
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    from tranche.llm.common import components

    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    expected = brute_components([(n, p) for n, p in enumerate(prints)])
    ours = brute_groups([roots.get(p, p) for p in signed])
    assert ours == brute_groups([c for _, _, c in expected])
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), distance=3)


def brute_groups(keys):
    groups = defaultdict(list)
    for n, k in enumerate(keys):
        groups[k].append(n)
    return sorted(groups.values())


def test_one_of_each_keeps_the_smallest_id_once(spark):
    kept = simhash.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 6, 7, 8, 10, 11]
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0
