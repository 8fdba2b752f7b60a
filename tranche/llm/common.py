"""What the corpus operators share: tables, column names, written intermediate tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.plans.session import shared_folder, written_once

#: Labelled rows that a model is fitted on, at most about as many; the choice hangs on the id alone.
SAMPLE_ROWS = 20_000

#: Rows and bytes that a Python task gets at once. The first document of a batch always fits.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

__all__ = ["SAMPLE_ROWS", "components", "fresh", "keyed", "labelled_sample", "map_batches", "read_table", "shared_folder", "training_fold", "written_once"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows, as texts are long. Sets the session's limits to ``ARROW_LIMITS``."""
    for key, most in ARROW_LIMITS.items():
        df.sparkSession.conf.set(key, most)
    return df.mapInArrow(run, schema)


def keyed(doc_id: str | Column, text: str | Column) -> list[Column]:
    """128 bits that name a row by its content: equal rows get equal keys, also after a lost task is run again."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2")]


def training_fold(doc_id: str = "doc_id") -> Column:
    """False for the held-out third: ``crc32(doc_id as text) mod 3 = 1``. A null id counts as training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, label)`` of about ``most_rows`` training rows, chosen by a hash of the id, so alike on every run.

    Ids labelled twice count with their largest label. The chosen labels are few by this bound and are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & training_fold())
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = known.count()
    if rows > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(most_rows / rows * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def components(edges: DataFrame, purpose: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of the edges ``(a, b)``: rows ``(node, root)``, root the smallest node reachable.

    Alternating star contractions. Every round is written to the shared folder, so a lost executor costs one round at most.
    Each round only groups to minima and joins a unique side, so a node of any degree is split by a skewed join.
    Nodes without edges are not returned. Null ends are dropped; an edge from a node to itself returns the node.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null")
    now = written_once(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # Every node's larger neighbours move to the smallest node in its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Then every node and its smaller neighbours move to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        now = written_once(small, purpose)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
