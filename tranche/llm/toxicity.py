"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, then scores of the context windows.

The lexicon holds given terms and whole words or stems learnt from labelled documents. Its trie and the automata of all
its terms are walked together and made deterministic as words need it, so a word costs a few table look-ups and most
words leave the automaton after a few letters. Each hit is read in its window: quoted or reported, directed at someone,
or plain. What a hit of a term at a distance in such a window says is estimated from the labels.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import SAMPLE_ROWS, labelled_sample, map_batches

#: Insults that need no labels.
TERMS = ("idiot", "moron", "loser", "stupid", "trash", "scum", "clown", "pathetic", "worthless", "disgusting")
#: Words that report or discuss a term, and words of direct address.
REPORTING = frozenset("called calls call calling said says saying word words term terms quote quoted quotes slur insult insults wrote writes define defined means meaning".split())
ADDRESS = frozenset("you your youre u ur yourself yall".split())
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$", "oieastas")

PLAIN, QUOTED, DIRECTED = 0, 1, 2
#: Hits and misses that the labels are added to, by distance and by window: what is believed without any label.
PRIOR = {0: (9.0, 1.0), 1: (4.0, 1.0), 2: (2.0, 2.0)}
WINDOW_PRIOR = {PLAIN: (0.0, 0.0), QUOTED: (0.0, 8.0), DIRECTED: (2.0, 0.0)}
STEMS = range(3, 9)
#: Share of toxic documents among those with a learnt form, at least.
LEAST_SHARE = 0.6
#: A term's hits in a text of more words than this count in proportion.
PASSAGE_WORDS = 500

WORD = re.compile(r"\w+")
#: What is written with look-alike signs that words don't hold; with a letter, as amounts are none.
SIGNED = re.compile(r"(?<![\w@$])(?=[\w@$]*[@$])(?=[\w@$]*[^\W\d_])[\w@$]+")
#: Terms of so many letters are matched with one edit where the labels support it.
SHORT = 4
DEAD = 0


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits_allowed(term: str, loose: frozenset[str] = frozenset()) -> int:
    """None below five letters, unless the term is among the loose ones; one below eight, then two."""
    return (len(term) >= 5 or term in loose) + (len(term) >= 8)


class Automaton:
    """Deterministic automaton of all words within the allowed edits of a term, and of all words that begin with a stem."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), loose: Iterable[str] = ()):
        self.loose = frozenset(loose)
        self.terms: list[tuple[str, bool]] = [(t, False) for t in terms] + [(s, True) for s in stems]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room: list[int] = [0]  # most edits that a term below a node allows
        for n, (term, stem) in enumerate(self.terms):
            node, edits = 0, 0 if stem else edits_allowed(term, self.loose)
            self.room[0] = max(self.room[0], edits)
            for c in term:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                self.room[node] = max(self.room[node], edits)
            self.ends[node].append(n)
        self.alphabet = {c for node in self.children for c in node}
        self.numbers: dict[frozenset, int] = {frozenset(): DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.finals: list[tuple[int, int] | None] = [None]
        self.stem_finals: list[tuple[int, int] | None] = [None]
        self.start = self.number(self.closed({(0, 0)}))

    def closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With what letters missing from the word reach, and of each node the fewest edits only."""
        fewest: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, edits = todo.pop()
            if edits > self.room[node] or fewest.get(node, 9) <= edits:
                continue
            fewest[node] = edits
            todo.extend((child, edits + 1) for child in self.children[node].values())
        return frozenset(fewest.items())

    def number(self, states: frozenset) -> int:
        known = self.numbers.get(states)
        if known is None:
            known = self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            hits = [(edits, n, self.terms[n][1]) for node, edits in states for n in self.ends[node]]
            ends = [(e, n) for e, n, stem in hits if (stem and not e) or (not stem and e <= edits_allowed(self.terms[n][0], self.loose))]
            self.finals.append(min(ends, default=None))
            self.stem_finals.append(min(((e, n) for e, n, stem in hits if stem and not e), default=None))
        return known

    def step(self, state: int, c: str) -> int:
        c = c if c in self.alphabet else ""
        found = self.moves[state].get(c)
        if found is None:
            after = set()
            for node, edits in self.sets[state]:
                after.add((node, edits + 1))  # a letter too many
                for letter, child in self.children[node].items():
                    after.add((child, edits + (letter != c)))
            found = self.moves[state][c] = self.number(self.closed(after))
        return found

    def hit(self, word: str) -> tuple[int, int] | None:
        """``(edits, term number)`` of the nearest term; of several the first. A stem hits every word that begins with it."""
        state = self.start
        begun = None
        for c in word:
            state = self.step(state, c)
            if state == DEAD:
                return begun
            begun = begun or self.stem_finals[state]
        ends = [x for x in (self.finals[state], begun) if x]
        return min(ends, default=None)


@dataclass
class Model:
    """Terms, stems and what a hit says; small, and shipped with the tasks."""

    terms: list[str]
    stems: list[str]
    weights: dict[tuple[int, int, int, int], float] = field(default_factory=dict)
    base: float = 0.02
    loose: list[str] = field(default_factory=list)

    def weight(self, term: int, edits: int, window: int, often: int) -> float:
        known = self.weights.get((term, edits, window, often))
        if known is None:
            known = smoothed(0, 0, edits, window)
        return known


def smoothed(toxic: float, clean: float, edits: int, window: int) -> float:
    yes, no = (a + b for a, b in zip(PRIOR[edits], WINDOW_PRIOR[window], strict=True))
    return (toxic + yes) / (toxic + clean + yes + no)


class Scorer:
    """Finds and weighs the hits of whole texts. Remembers words, up to a bound."""

    MOST_WORDS = 100_000

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms, model.stems, model.loose)
        self.known: dict[str, tuple[int, int] | None] = {}

    def hit(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.hit(word)
        if (found is None or found[0]) and not word.isalpha():
            plain = word.translate(LOOKALIKES)
            other = self.automaton.hit(plain) if plain != word and plain.isalpha() else None
            found = min((x for x in (found, other) if x), default=None)
        return found

    def signed_hit(self, word: str) -> tuple[int, int] | None:
        """The hit of a word written with signs, if it is nearer than those of the words between the signs."""
        plain = word.translate(LOOKALIKES)
        found = self.automaton.hit(plain) if plain.isalpha() else None
        between = min((x for x in map(self.hit, WORD.findall(word)) if x), default=None)
        return found if found and (between is None or found[0] < between[0]) else None

    def hits(self, text: str) -> set[tuple[int, int, int, int]]:
        """What is found, as ``(term, edits, window, often)``; often is 1, 2 or 3, for three times and more."""
        known = self.known
        if len(known) > self.MOST_WORDS:
            known.clear()
        low = text.lower()
        found, signed = {}, {}
        tokens = WORD.findall(low)
        for word in set(tokens):
            if word not in known:
                known[word] = self.hit(word)
            if known[word] is not None:
                found[word] = known[word]
        if "@" in low or "$" in low:
            for word in set(SIGNED.findall(low)):
                if word not in known:
                    known[word] = self.signed_hit(word)
                if known[word] is not None:
                    signed[word] = known[word]
        if not found and not signed:
            return set()
        times: Counter = Counter()
        either = lambda some: "|".join(map(re.escape, sorted(some)))
        forms = [rf"(?<![\w@$])(?:{either(signed)})(?![\w@$])"] * bool(signed) + [rf"(?<!\w)(?:{either(found)})(?!\w)"] * bool(found)
        found |= signed
        for m in re.finditer("|".join(forms), low):
            edits, term = found[m.group()]
            times[term, edits, window(low, m.start(), m.end())] += 1
        share = PASSAGE_WORDS / max(PASSAGE_WORDS, len(tokens))
        return {(*key, min(3, max(1, int(n * share)))) for key, n in times.items()}

    def score(self, text: str | None) -> float:
        """Between 0 and 1. The strongest hit counts; up to three further terms add to it. Null and empty: the base rate."""
        hits = self.hits(text or "")
        if not hits:
            return self.model.base
        best: dict[int, float] = defaultdict(float)
        for term, edits, where, often in hits:
            best[term] = max(best[term], self.model.weight(term, edits, where, often))
        return max(self.model.base, 1 - (1 - max(best.values())) * 0.8 ** min(len(best) - 1, 3))


OPENING = re.compile(r"(?:^|[\s(\[])[\"'“«„‘]\s?[^\"'“”«»„‘’\n]{0,60}$")
CLOSING = re.compile(r"^[^\"'“”«»„‘’\n]{0,60}[\"'”»’](?:$|[^\w])")


def window(low: str, start: int, end: int) -> int:
    """How the words at ``start:end`` of a lower-case text are used: quoted or reported, directed at someone, or plain."""
    left, right = low[max(0, start - 80) : start], low[end : end + 80]
    before, after = WORD.findall(left.replace("'", ""))[-4:], WORD.findall(right.replace("'", ""))[:3]
    directed = not ADDRESS.isdisjoint(before + after)
    quoted = bool(OPENING.search(left) and CLOSING.search(right))
    reported = not REPORTING.isdisjoint(before)
    if quoted and (reported or not directed):
        return QUOTED
    if directed:
        return DIRECTED
    return QUOTED if reported else PLAIN


def forms(text: str) -> set[tuple[str, bool]]:
    """The words of a text, and as stems what at least two of its words begin with."""
    tokens = Counter(w for w in words(text) if len(w) >= 3 and not w.isdigit())
    begun: Counter = Counter()
    for word, n in tokens.items():
        for length in STEMS:
            if length >= len(word):
                break
            begun[word[:length]] += n
    return {(w, False) for w in tokens} | {(f, True) for f, n in begun.items() if n > 1}


def evidence(toxic: int, clean: int, rate: float) -> float:
    """Log likelihood ratio of a form's share of toxic documents against the share ``rate`` of all; 0 if it is too low."""
    share = toxic / (toxic + clean) if toxic else 0.0
    if share < max(LEAST_SHARE, rate):
        return 0.0
    return toxic * log(share / rate) + (clean * log((1 - share) / (1 - rate)) if clean else 0.0)


def learn_terms(sample: DataFrame, known: Iterable[str], most_chance: float = 0.01) -> tuple[list[str], list[str]]:
    """Words and stems that the labels show to be toxic: ``(terms, stems)``.

    A form must be found mostly in toxic documents, and in more than chance gives any of a million forms tried. Of those,
    forms are taken by how many toxic documents they explain that no form before does, so a rare word in a group of
    copies adds nothing. A stem is taken over a word only if it explains more, and the longest of equal stems.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                (toxic if label.as_py() else clean).update(forms(text.as_py() or ""))
        keys = list(toxic)  # forms of clean documents alone can't be chosen, but must count against those below
        keys += [k for k in clean if k not in toxic]
        if keys:
            columns = [[k[0] for k in keys], [k[1] for k in keys], [toxic[k] for k in keys], [clean[k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["form", "stem", "toxic", "clean"])

    counted = map_batches(sample, count, "form string, stem boolean, toxic long, clean long")
    counted = counted.groupBy("form", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = sample.agg(F.count("*").alias("n"), F.sum(F.expr("int(label = 1)")).alias("toxic")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return [], []
    rate = totals["toxic"] / totals["n"]
    least = log(1e6 / most_chance)
    # A form in so few toxic documents can't be evident; of the rest, the driver gets those that are.
    counted = counted.where((F.col("toxic") >= least / log(1 / rate)) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    clean_in = {(r["form"], r["stem"]): r["clean"] for r in counted.collect() if evidence(r["toxic"], r["clean"], rate) > least}
    candidates = set(clean_in)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[("+" if s else "-") + f for f, s in forms(t.as_py() or "") & candidates] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r in rows if r], pa.list_(pa.string()))], names=["forms"])

    scorer = Automaton(known)
    held: dict[str, set[int]] = defaultdict(set)
    for n, row in enumerate(map_batches(sample.where("label = 1"), holders, "forms array<string>").collect()):
        if not any(f[0] == "-" and scorer.hit(f[1:]) for f in row["forms"]):
            for f in row["forms"]:
                held[f].add(n)
    terms, stems = [], []
    gain = lambda f: evidence(len(held[f]), clean_in[f[1:], f[0] == "+"], rate)
    while held:
        best = max(held, key=lambda f: (gain(f), f[0] == "-", len(f), f))
        if gain(best) <= least:
            break
        (stems if best[0] == "+" else terms).append(best[1:])
        done = held.pop(best)
        held = {f: rest for f, docs in held.items() if (rest := docs - done)}
    return terms, stems


def supported(sample: DataFrame, model: Model, most_chance: float = 0.01) -> list[str]:
    """The short terms whose forms at one edit the labels show to be toxic, in documents where nothing else hits."""
    short = {n: t for n, t in enumerate(model.terms) if len(t) == SHORT}
    if not short:
        return []
    trial = replace(model, loose=list(short.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = Scorer(trial), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                hits, toxic = scorer.hits(text.as_py() or ""), int(label.as_py() == 1)
                seen[-1, toxic] += 1
                if all(edits and term in short for term, edits, _, _ in hits):
                    seen.update((term, toxic) for term in {h[0] for h in hits})
        if seen:
            columns = [*zip(*seen, strict=True), tuple(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "label", "n"])

    counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for r in map_batches(sample, count, "term long, label long, n long").groupBy("term", "label").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]][r["label"]] += r["n"]
    clean, toxic = counts.pop(-1, [0, 0])
    if not clean or not toxic:
        return []
    least = log(len(short) / most_chance)
    return sorted(short[n] for n, (no, yes) in counts.items() if evidence(yes, no, toxic / (toxic + clean)) > least)


def fit(docs: DataFrame, labels: DataFrame, terms: Iterable[str] = TERMS, most_rows: int = SAMPLE_ROWS) -> Model:
    """Learn terms, stems and weights from a bounded sample of the labelled training rows. Without labels: the given terms."""
    sample = labelled_sample(docs, labels, "toxic", most_rows).persist()
    try:
        more, stems = learn_terms(sample, terms)
        model = Model([*terms, *(t for t in more if t not in set(terms))], stems)
        model.loose = supported(sample, model)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, seen = Scorer(model), Counter()
            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1), strict=True):
                    for key in scorer.hits(text.as_py() or "") or [(-1, 0, 0, 0)]:
                        seen[*key, int(label.as_py() == 1)] += 1
            if seen:
                columns = [*zip(*seen, strict=True), tuple(seen.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "edits", "place", "often", "label", "n"])

        counts: dict[tuple[int, int, int, int], list[int]] = defaultdict(lambda: [0, 0])
        found = map_batches(sample, count, "term long, edits long, place long, often long, label long, n long")
        for r in found.groupBy("term", "edits", "place", "often", "label").agg(F.sum("n").alias("n")).collect():
            counts[r["term"], r["edits"], r["place"], r["often"]][r["label"]] += r["n"]
    finally:
        sample.unpersist()
    clean, toxic = counts.pop((-1, 0, 0, 0), [0, 0])
    model.base = min(0.5, (toxic + 0.2) / (toxic + clean + 10))
    model.weights = {k: smoothed(toxic, clean, k[1], k[2]) for k, (clean, toxic) in counts.items()}
    return model


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, repeated ones and null ids included. Only the text is scored; null is empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, score double")


def acceptable(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns. Each row is judged by its own text."""
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(column)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
