"""Line dedup by distinct-site spread; DataFrame functions only.

Lines are grouped by 128-bit hash. The group's HyperLogLog sketch of the sites merges in the same aggregation that counts
its lines and finds its first place, so a line that fills a third of the corpus is one row a task after the map side.
Lines whose estimate is near the threshold get an exact distinct count. Long lines don't recur naturally and may have a
lower threshold, for sites of unlike texts, always counted exactly up to where the higher one decides. A line spread over enough sites is boilerplate
and stays at its first place in the corpus only, so no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import fresh, keyed, written_once

#: A line on so many distinct sites is boilerplate.
SITES = 10
#: A line of more words than this is long; one on so many distinct sites is boilerplate in the pipeline.
LONG_WORDS, LONG_SITES = 50, 3
#: Registers of a sketch as a power of two: its standard error is 1.04 / sqrt(2^12), about 1.6 %.
LG_REGISTERS = 12
#: Estimates this far from the threshold, over fifteen standard errors, are taken as they are.
BAND = 0.25


def lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """``(k1, k2, doc_id, site, place, h1, h2, whole)`` for each line that isn't blank. Lines differ by what is between blanks.

    ``whole`` is a hash of the whole text for long lines, and null for others.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("site"))
    # Texts are hashed once, not once a line.
    picked = picked.select(*keyed("doc_id", "text"), "doc_id", "site", F.xxhash64("text").alias("whole"), "text")
    each = picked.select("k1", "k2", "doc_id", "site", "whole", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    line = F.btrim("line", F.lit(" \t\r"))
    each = each.where(F.length(line) > 0)
    # So many words have twice as many characters; most lines needn't be split.
    long = (F.length(line) > 2 * LONG_WORDS) & (F.size(F.split(line, r"\s+")) > LONG_WORDS)
    return each.select(
        "k1", "k2", "doc_id", "site", "place", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.when(long, F.col("whole")).alias("whole")
    )


def boilerplate(each: DataFrame, sites: int = SITES, long_sites: int | None = None) -> DataFrame:
    """``(h1, h2, k1, k2, place)``: the hashes of lines on at least ``sites`` distinct sites, and their first place.

    Long lines need ``long_sites`` only, where that is given. For that, rows with one text count as on the smallest of their
    sites, as copies of a whole document are no passage. The first place is that of the smallest ``(doc_id, place)``. A null
    site is no site.
    """
    grouped = each.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"),
        F.count("site").alias("n"),
        F.min(F.struct("doc_id", "k1", "k2", "place")).alias("first"),
        F.max(F.col("whole").isNotNull()).alias("long"),
    )
    least = F.lit(sites) if long_sites is None else F.when(F.col("long"), min(sites, long_sites)).otherwise(sites)
    # A line is on no more sites than it has rows.
    spread = grouped.where(F.col("n") >= least).select("h1", "h2", "first", "long", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = written_once(spread.where(F.col("estimate") >= least * (1 - BAND)), "line-spread")
    near = spread.where(F.col("estimate") <= sites * (1 + BAND)).select("h1", "h2")
    met = each.select("h1", "h2", "site", "whole").join(near, ["h1", "h2"])
    exact = met.select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    if long_sites is not None:
        unlike = met.where("whole is not null").groupBy("h1", "h2", "whole").agg(F.min("site").alias("site"))
        unlike = unlike.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("n"))
        exact = exact.unionByName(unlike.where(F.col("n") >= long_sites).select("h1", "h2")).distinct()
    sure = spread.where(F.col("estimate") > sites * (1 + BAND))
    return sure.unionByName(spread.join(exact, ["h1", "h2"])).select("h1", "h2", "first.k1", "first.k2", "first.place")


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, counts: bool = False,
    long_sites: int | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines left out of ``text``; all columns and rows are kept, texts may become empty.

    With ``counts``, ``n_lines`` and ``n_removed`` are appended. A null text stays null and has no lines; an empty one has
    one blank line. With ``long_sites``, long lines on so many sites are boilerplate too. Rows that agree in id and text are one document and keep the same lines. Blank lines stay.
    """
    each = written_once(lines(docs, doc_id, text, site), "lines")
    common = boilerplate(each, sites, long_sites).withColumnsRenamed({"k1": "f1", "k2": "f2", "place": "first_place"})
    again = each.select("k1", "k2", "place", "h1", "h2").join(common, ["h1", "h2"])
    again = again.where(~((F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("place") == F.col("first_place"))))
    gone = again.groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    k1, k2, names = fresh(docs, "k1"), fresh(docs, "k2"), docs.columns
    left, right = keyed(F.col(doc_id), F.col(text))
    marked = docs.withColumns({k1: left, k2: right})
    gone = gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(fresh(docs, "gone")))
    marked = marked.join(gone, [k1, k2], "left")
    out = F.col(gone.columns[2])
    cut = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), out)
    short = F.array_join(F.transform(kept, lambda i: F.get(cut, i)), "\n")
    clean = F.when(out.isNull(), F.col(text)).otherwise(short).alias(text)
    more = [F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_removed")]
    return marked.select(*[clean if c == text else F.col(f"`{c}`") for c in names], *(more if counts else []))


#: The rows of ``op8``: exact distinct counts for all lines.
ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
n AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS norm FROM l),
b AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING COUNT(DISTINCT source) >= {SITES}),
f AS (SELECT doc_id, place, ROW_NUMBER() OVER (PARTITION BY norm ORDER BY doc_id, place) AS nth FROM n JOIN b USING (norm)),
k AS (SELECT n.doc_id, n.place, n.line, COALESCE(f.nth, 1) = 1 AS stays
      FROM n LEFT JOIN f ON n.doc_id = f.doc_id AND n.place = f.place)
SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_lines, CAST(COUNT(*) FILTER (NOT stays) AS BIGINT) AS n_removed,
       COALESCE(STRING_AGG(line, chr(10) ORDER BY place) FILTER (stays), '') AS text
FROM k GROUP BY doc_id
"""
