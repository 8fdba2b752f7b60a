import random

import pytest

from tests.llm.rows import TEXTS, documents, empty
from tranche.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a, 1):
        new = [n]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_what_the_edit_distance_allows():
    terms = [*tx.TERMS, "ox"]
    automaton, rng = tx.Automaton(terms), random.Random(2)
    words = ["", "a", "closer", "close"]
    for term in terms:
        for _ in range(60):
            word = list(term)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], [rng.choice(term)]])
            words.append("".join(word))
    for word in words:
        near = min(((distance(word, t), n) for n, t in enumerate(terms) if distance(word, t) <= tx.edits_allowed(t)), default=None)
        assert automaton.hit(word) == near, word


def test_stems_hit_what_begins_with_them():
    automaton = tx.Automaton(["idiot"], ["vequ"])
    assert automaton.hit("vequille") == automaton.hit("vequ") == (0, 1)
    assert automaton.hit("veqille") is None and automaton.hit("xvequ") is None


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("you are an idiot", True), ("what a worthles pile", True), ("you m0ron", True), ("utter trash", True),
        ('she said the word "idiot" has Greek roots', False), ("the term moron is an insult", False),
        ("a plain text", False), ("", False), (None, False), ('you "idiot", you', True),
    ],
)
def test_windows_tell_quotation_from_abuse(text, toxic):
    score = tx.Scorer(tx.Model(list(tx.TERMS), [])).score(text)
    assert 0 <= score <= 1 and (score >= 0.7) == toxic


def corpus(spark):
    """Toxic texts use made-up stems beside the given terms; half of the labels stay hidden from the fit."""
    rng, rows, labels = random.Random(3), [], []
    plain = [f"{a}{b}" for a in ("ra", "ne", "to", "li", "su") for b in ("mon", "del", "vor", "tis", "pan", "kel")]
    for n in range(600):
        text, toxic = rng.choices(plain, k=rng.randint(5, 60)), n % 5 == 0
        if toxic:
            bad = ["zurgh" + rng.choice(plain) for _ in range(3)] if n % 2 else ["idiot"]
            for word in bad:
                text.insert(rng.randrange(len(text)), word)
        rows.append((n, " ".join(text)))
        labels.append((n, 1, int(toxic)))
    labels += [(None, 1, 1), (0, 1, 1), (7, None, None)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stems_are_learnt_and_hold_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = tx.fit(docs, labels)
    assert any("zurgh".startswith(s) or s.startswith("zurgh") for s in model.stems)
    scores = {r["doc_id"]: r["score"] for r in tx.scores(docs, model).collect()}
    wrong = [i for i, s in scores.items() if (s >= 0.7) != (i % 5 == 0)]
    assert len(scores) == 600 and len(wrong) <= 6


def test_awkward_rows_keep_their_place(spark):
    model = tx.Model(list(tx.TERMS), [])
    docs = documents(spark, [*TEXTS, (50, "you idiot"), (50, "you idiot")])
    assert tx.scores(docs, model).count() == len(TEXTS) + 2
    kept = tx.acceptable(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert tx.scores(empty(spark), model).count() == 0


def test_without_labels_the_given_terms_hold(spark):
    docs, labels = corpus(spark)
    model = tx.fit(docs, labels.limit(0))
    assert model.stems == [] and tx.Scorer(model).score("an idiot") >= 0.7


@pytest.mark.parametrize("text", ["utter tr@sh", "you $cum", "what $tup1d talk", "(m0r@n)", "idiot@home", "a tr@$h-heap, tr@sh"])
def test_signs_stand_for_letters(text):
    assert tx.Scorer(tx.Model(list(tx.TERMS), [])).score(text) >= 0.7


@pytest.mark.parametrize("text", ["a bill of $5 or $100", "bob@site.org", "$", "@@ $$", "a sum, a slum", 'the word "tr@sh" is an insult'])
def test_signs_alone_say_nothing(text):
    assert tx.Scorer(tx.Model(list(tx.TERMS), [])).score(text) < 0.7


@pytest.mark.parametrize(("toxic", "loose"), [(True, ["scum"]), (False, [])])
def test_labels_allow_an_edit_in_short_terms(spark, toxic, loose):
    """Different misspellings, so that none is learnt as a word of its own."""
    bad = [f"sc{c}um" for c in "abdefghijklmno"] + [f"s{c}um" for c in "abdefghijklmno"]
    rows = [(n, f"plain words and {bad[n // 5 % len(bad)] if n % 5 == 0 else 'more'} of them") for n in range(400)]
    labels = [(n, 1, int(n % 5 == (0 if toxic else 1))) for n in range(400)]
    model = tx.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.loose == loose
    assert (tx.Scorer(model).score("utter skum") >= 0.7) == toxic
