import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.rows import TEXTS, documents, empty, same
from tranche.llm import order_minhash as om


def brute_sketch(text):
    """Slot by slot, sorting all numbered k-mers."""
    h = om.kmer_hashes(om.code_points(text))
    seen, order = Counter(), []
    for x in h.tolist():
        seen[x] += 1
        order.append(int(om.mixed(np.array([x], np.uint64) + np.array([seen[x]], np.uint64) * om.MULTIPLIER)[0]))
    out = []
    for slot in range(om.SLOTS):
        chosen = sorted(sorted((n for n in range(len(order)) if order[n] >> 58 == slot), key=lambda n: order[n])[: om.TUPLE])
        v = np.zeros(1, np.uint64)
        for i, n in enumerate(chosen):
            v = om.mixed(v * om.MULTIPLIER + h[n : n + 1] + np.uint64(i + 1))
        out.append(int(v[0]) % 65535 + 1 if chosen else 0)
    return out


@pytest.mark.parametrize("text", ["", "a", "short text", "the the the the the the the the the", "ünï 😀 " * 40, TEXTS[8][1][:9000]])
def test_sketch_is_that_of_brute_force(text):
    assert om.sketch(om.kmer_hashes(om.code_points(text))).tolist() == brute_sketch(text)


def test_kmers_are_windows():
    text = "abcabcabcabcabcabc xyz xyz xyz xyz"
    for k in (1, 2, 5, 12, 100):
        windows = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
        names = {}
        assert [names.setdefault(w, h) for w, h in zip(windows, om.kmer_hashes(om.code_points(text), k).tolist(), strict=True)] == om.kmer_hashes(om.code_points(text), k).tolist()
        assert len(set(names.values())) == len(names)


def test_order_counts():
    a, b = TEXTS[8][1][:4000], TEXTS[8][1][4000:8000]
    f = lambda t: om.sketch(om.kmer_hashes(om.code_points(t)))
    assert om.likeness(f(a + b), f(a + b)) == 1.0
    assert om.likeness(f(a + b), f(b + a)) < 0.8  # the same k-mers but for the seam
    assert om.likeness(f(a + b), f(a + b[:-200])) > 0.7
    assert om.likeness(f(""), f("")) == 1.0 and om.likeness(f(""), f(a)) == 0.0


def report(rows):
    """Descending id, null last; of equal ids by hash of the text, so those here have equal texts."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: -(1 << 70) if r[0] is None else r[0], reverse=True)
    out = []
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        changed = om.edited(text, following)
        own, other, its = (om.sketch(om.kmer_hashes(om.code_points(t))) for t in (text, changed, following))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), om.digits(own), om.digits(other), om.likeness(own, other), om.likeness(own, its)))
    return out


ROWS = [r for r in TEXTS if r != (None, None)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[8:10], [(n, f"{n} text " * (n % 7)) for n in range(-40, 60)]])
def test_report_follows_the_ids(spark, rows):
    found = om.edit_report(documents(spark, rows), most_chars=100_000)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert found.columns == names
    same([tuple(r) for r in found.collect()], report(rows))


def test_empty_table_and_fingerprints(spark):
    assert om.edit_report(empty(spark)).count() == 0
    found = {(r["doc_id"], r["fingerprint"]) for r in om.fingerprints(documents(spark)).collect()}
    assert found == {(i, om.digits(om.sketch(om.kmer_hashes(om.code_points(t or ""))))) for i, t in TEXTS}
