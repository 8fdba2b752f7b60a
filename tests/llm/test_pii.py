import hashlib
import re

from tests.llm.rows import TEXTS, documents, empty, same
from tranche.llm import pii

#: The contract's own patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    plain = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(plain))]
        return 16 <= len(plain) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(plain) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


HARD = [
    "a@b.c_d@e.f x@y +1 (555) 010-2030 and +44 20 7946 0958.", "4111 1111-1111 1111 4111111111111112 4111111111111111",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.1 1..2.3.4", "😀 user@mail.example.com, ünï@x.org 10.0.0.1", "a" * 3000 + "@", "7" * 50_000,
    "x@" + "a." * 3000 + "b", "+" * 500 + "1 2" * 500, "%+-@-.-", "mail.bob@site.org@other.net", "1 2-3 4" * 400, None, "",
]


def contexts():
    rows = [(1000 + n, f"please call me at +1 (555) 010-{1000 + n} today") for n in range(12)]
    rows += [(2000 + n, f"please call me at 555-010-{2000 + n} today") for n in range(3)]
    return rows + [(3000 + n, f"order number {10_000 + 37 * n} was shipped") for n in range(12)]


def test_base_spans_are_those_of_the_contract(spark):
    rows = [*enumerate(HARD), *TEXTS, (1, HARD[0]), (500, HARD[0])]
    got = {}
    for r in pii.report(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:6])
    expected = {}
    for i, text in rows:
        spans = base(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        expected.setdefault(i, []).append((*(sum(s[0] == k for s in spans) for k in PATTERNS), digest))
    assert got.keys() == expected.keys()
    for i in expected:
        same(got[i], expected[i])


def test_contexts_reveal_what_no_pattern_finds(spark):
    spans = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, contexts())).collect()}
    for n in range(3):
        assert spans[2000 + n] == "context-phone:18:30"
    assert all(spans[3000 + n] == "" for n in range(12))
    assert all(spans[1000 + n] == "phone:18:35" for n in range(12))


def test_confidence_spreads_over_the_graph(spark):
    edges = [("a", f"s{n}", "email") for n in range(9)] + [("a", "u", None), ("b", "u", None)] + [("b", f"s{n}", "email") for n in range(4)]
    frame = spark.createDataFrame(edges, "pattern string, value string, kind string")
    first = {r["pattern"]: r["confidence"] for r in pii.confident(frame, rounds=1).collect()}
    later = {r["pattern"]: r["confidence"] for r in pii.confident(frame, rounds=2).collect()}
    assert abs(first["a"] - 9 / 11) < 1e-9 and abs(first["b"] - 4 / 6) < 1e-9
    assert abs(later["b"] - (4 + 9 / 11) / 6) < 1e-9


def test_empty_table_and_no_python(spark):
    found = pii.report(empty(spark))
    assert found.count() == 0
    plan = pii.report(documents(spark, TEXTS[:3]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_found_values_promote_patterns_without_seeds(spark):
    """Account numbers known only from a call context, then others known only from the context of those: three generations."""
    rows = [(1000 + n, f"please call me at +1 (555) 010-{1000 + n} today") for n in range(40)]
    for n in range(12):
        rows.append((2000 + n, f"please call me at 71-{5000 + n} today"))
        rows.append((3000 + n, f"the customer account 71-{5000 + n} belongs here"))
        if n < 6:
            rows.append((5000 + n, f"new secret ledger 88-{6000 + n} closes"))
    rows += [(4000 + n, f"the customer account 88-{6000 + n} belongs here") for n in range(2)]
    rows += [(6000 + n, f"order number {10_000 + 37 * n} was shipped") for n in range(12)]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert all(spans[2000 + n] == "context-phone:18:25" for n in range(12))
    assert all(spans[3000 + n] == "context-phone:21:28" for n in range(12))
    assert all(spans[4000 + n] == "context-phone:21:28" for n in range(2))
    assert all(spans[5000 + n] == spans[6000 + n] == "" for n in range(6))


def test_rounds_go_on_until_nothing_is_added(spark):
    """A chain of patterns, each of which shares its values with the one before."""
    edges = [("p0", f"s{n}", "email") for n in range(60)]
    edges += [(f"p{k + d}", f"v{k}_{n}", None) for k in range(8) for n in range(6) for d in (0, 1)]
    edges += [(f"p{k}", f"s{n}", "email") for k in range(1, 8) for n in range(20)]
    frame = spark.createDataFrame(edges, "pattern string, value string, kind string")
    assert "p8" not in {r["pattern"] for r in pii.confident(frame, rounds=3).collect()}
    out = {r["pattern"]: r for r in pii.confident(frame).collect()}
    assert out["p8"]["seeds"] == 0 and out["p8"]["evidence"] > 4
