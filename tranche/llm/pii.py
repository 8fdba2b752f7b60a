"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers: the seeds. The words around the seeds are
lexical patterns. Patterns and the values they surround form a graph on which confidence spreads: a pattern is as good as
the share of its values that are known, a value as good as the patterns it is found in. A value found so counts towards
patterns without any base seed too. When rounds add nothing more, patterns of high confidence tell which other identifiers
are personal data too.

Positions come from the texts between matches: their lengths add up in a window over the matches of one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tranche.llm.common import keyed, written_once

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in a form that takes linear time on any text: a run is tried from its start only (or from where the
#: match before ended), and repetitions never go back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Words with a digit or an at sign: what may be an identifier.
    "word": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
}
BLANKS = r"[\x20\x09-\x0D]+"
#: Characters of the surroundings that patterns are made of.
AROUND = 60
#: Rounds end when none adds a pattern or a value; more than so many fail the call.
MOST_ROUNDS = 60
#: The sum of the values' scores must have settled too, by this share.
SETTLED = 1e-4
#: A pattern needs this confidence, and so much evidence, to take part in a round, or to extract. A distinct seed is one,
#: a found value as much as its score.
SPREADS, LEAST_SEEDS = 0.7, 3
EXTRACTS, LEAST_EVIDENCE = 0.8, 5
KEY = ["k1", "k2"]


def digits(value: str | Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, is a multiple of ten."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda c: c.cast("int"))
    return F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """What a match of a base pattern must meet besides; one that fails is dropped."""
    plain = digits(value)
    small = F.forall(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.length(plain).between(16, 19) & luhn(plain))
        .when(kind == "phone", F.length(plain).between(8, 15))
        .otherwise(F.lit(True))
    )


def matches(texts: DataFrame) -> DataFrame:
    """``(k1, k2, kind, value, start, end, left, right)``: all matches of all patterns in ``(k1, k2, text)``, unchecked.

    One scan. Matches and the texts between them come from the same search, so they alternate; a shuffle brings the matches
    of a document together with the lengths and the ends of the texts between them, never the texts themselves.
    """
    likely = {
        "email": F.col("text").contains("@"),
        "ip": F.col("text").contains("."),
        "card": F.lit(True),
        "phone": F.col("text").contains("+"),
        "word": F.lit(True),
    }
    some = F.col("text").rlike("[0-9@]")

    def pairs(kind: str) -> Column:
        between = F.transform(
            F.split("text", PATTERNS[kind], -1),
            lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(AROUND)).alias("tail"), F.left(g, F.lit(AROUND)).alias("head")),
        )
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        both = F.zip_with(found, between, lambda m, g: F.struct(m.alias("value"), g.n.alias("n"), g.tail.alias("tail"), g.head.alias("head")))
        return F.struct(F.lit(kind).alias("kind"), F.when(likely[kind], both).alias("found"))

    each = texts.where(some).select(*KEY, F.explode(F.array(*[pairs(k) for k in PATTERNS])).alias("of"))
    each = each.select(*KEY, "of.kind", F.posexplode("of.found").alias("nth", "pair"))
    each = each.where("pair.value is not null or nth > 0").select(*KEY, "kind", "nth", "pair.*")
    each = each.dropDuplicates([*KEY, "kind", "nth"])  # rows that repeat
    ordered = Window.partitionBy(*KEY, "kind").orderBy("nth")
    length = F.coalesce(F.length("value"), F.lit(0))
    end = F.sum((F.col("n") + length).cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumns({"end": end, "right": F.lead("head").over(ordered)}).where("value is not null")
    return each.select(*KEY, "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end", F.col("tail").alias("left"), "right")


def lexical(left: Column, right: Column) -> Column:
    """Up to two patterns: the two words before, and the word before with the word after. Digits are alike."""
    shape = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "9")
    before = F.filter(F.split(shape(left), BLANKS), lambda w: w != "")
    after = F.filter(F.split(shape(right), BLANKS), lambda w: w != "")
    two = F.when(F.size(before) > 1, F.concat(F.lit("2 "), F.element_at(before, -2), F.lit(" "), F.element_at(before, -1)))
    around = F.when((F.size(before) > 0) & (F.size(after) > 0), F.concat(F.lit("1 "), F.element_at(before, -1), F.lit(" _ "), F.element_at(after, 1)))
    return F.array_compact(F.array(two, around))


def free_words(base: DataFrame, words: DataFrame) -> DataFrame:
    """The words that no base span overlaps. Two windows over a document's spans, one from each end."""
    spans = base.select(*KEY, "start", "end", F.lit(True).alias("seed"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    both = spans.unionByName(words.select(*KEY, "start", "end", F.lit(False).alias("seed"), "value", "left", "right"))
    up = Window.partitionBy(*KEY).orderBy("start", F.desc("seed")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*KEY).orderBy(F.desc("start"), F.desc("seed")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"before": F.max(F.when(F.col("seed"), F.col("end"))).over(up), "next": F.min(F.when(F.col("seed"), F.col("start"))).over(down)})
    free = ~F.col("seed") & (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return both.where(free).select(*KEY, "start", "end", "value", "left", "right")


def trimmed() -> tuple[Column, Column, Column]:
    """Value, start and end of a word without the signs around it; names it by what is left."""
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+@]*", 0))
    value = F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}0-9+@]+", ""), r"[^\p{L}0-9]+$", "")
    return value.alias("value"), (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(value)).alias("end")


def confident(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(pattern, kind, confidence, seeds, evidence)`` of the graph's edges ``(pattern, value, kind)``; kind is null for unknown values.

    Each round scores the patterns by the values they surround, then the unknown values by their patterns. Both are sums
    that combine before the shuffle; what a round found is written, so the next one starts from it. Without ``rounds``,
    they go on until no pattern that spreads, or extracts, and no value is added.
    """
    unknown = edges.where("kind is null").select("pattern", "value")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    spreads = (F.col("confidence") >= SPREADS) & (F.col("evidence") >= LEAST_SEEDS)
    extracts = (F.col("confidence") >= EXTRACTS) & (F.col("evidence") >= LEAST_EVIDENCE)
    found = out = before = None
    for _ in range(rounds or MOST_ROUNDS):
        if found is None:
            met = seeds.withColumn("more", F.lit(0.0))
        else:
            more = unknown.join(found, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            met = seeds.join(more, ["pattern", "kind"], "full")
        met = met.select("pattern", "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), F.coalesce("more", F.lit(0.0)).alias("more"))
        evidence = F.col("seeds") + F.col("more")
        # A share of all values, and one value more that isn't known.
        share = evidence / (F.col("values") + 1)
        met = met.join(sizes, "pattern").select("pattern", "kind", F.least(share, F.lit(0.99)).alias("confidence"), "seeds", evidence.alias("evidence"))
        out = written_once(met, "pii-patterns")
        scored = unknown.join(out.where(spreads), "pattern")
        found = scored.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        if rounds is None:
            found = written_once(found, "pii-values")
            patterns = out.agg(F.count_if(spreads), F.count_if(extracts)).first()
            n, total = found.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
            now = (*patterns, n)
            # Scores only grow: sets of equal size are equal sets, but a score may be on its way to the threshold.
            if before and now == before[0] and total - before[1] <= SETTLED * total:
                break
            before = now, total
    else:
        if rounds is None:
            raise RuntimeError(f"patterns did not settle in {MOST_ROUNDS} rounds")
    return out


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k1, k2, kind, start, end)`` in code points, end exclusive; the key names a document by id and text.

    Base spans have the four base kinds. Identifiers that contexts reveal have ``context-`` before the kind of the seeds
    that their pattern was learnt from; none of them overlaps a base span. Spans of a kind never overlap.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_found = matches(texts.select(*keyed("doc_id", "text"), "text"))
    all_found = written_once(all_found.where((F.col("kind") == "word") | valid(F.col("kind"), F.col("value"))), "pii-matches")
    base, words = all_found.where("kind != 'word'"), all_found.where("kind = 'word'")
    value, start, end = trimmed()
    # An identifier has an at sign, or four digits at least.
    free = free_words(base, words).select(*KEY, value, start, end, "left", "right")
    free = written_once(free.where(F.col("value").contains("@") | (F.length(digits("value")) >= 4)), "pii-words")
    around = lexical(F.col("left"), F.col("right"))
    edges = base.select("value", "kind", F.explode(around).alias("pattern"))
    edges = edges.unionByName(free.select("value", F.lit(None).cast("string").alias("kind"), F.explode(around).alias("pattern")))
    edges = written_once(edges.distinct(), "pii-edges")
    sure = confident(edges).where((F.col("confidence") >= EXTRACTS) & (F.col("evidence") >= LEAST_EVIDENCE))
    more = free.select(*KEY, "start", "end", F.explode(around).alias("pattern")).join(sure, "pattern")
    more = more.groupBy(*KEY, "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    more = more.select(*KEY, F.concat(F.lit("context-"), F.col("best.kind")).alias("kind"), "start", "end")
    return base.select(*KEY, "kind", "start", "end").unionByName(more)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``. The counts are those of base spans.

    Null and empty texts have no spans. Rows that agree in id and text get the same answer, one each. Ids may be null.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *keyed("doc_id", "text"))
    order = reduce(lambda out, k: out.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), 0)).otherwise(len(KINDS))
    each = spans(docs, doc_id, text).withColumn("at", order)
    each = each.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "start", "end"))).alias("all"))
    written = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("all", lambda s: s.at < len(KINDS))
    of_kind = lambda k: F.size(F.filter("all", lambda s: s.kind == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    told = each.select(*KEY, *counts, written(base).alias("base"), written(F.col("all")).alias("spans"))
    joined = rows.join(told, KEY, "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
