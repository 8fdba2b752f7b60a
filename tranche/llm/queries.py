"""Queries of the corpus operators, one each, and the pipeline; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.llm import alignment, bpe, decontamination, hard_negatives, licenses, line_dedup, order_minhash, pii, quality, sentencepiece_codec, simhash, toxicity, warc
from tranche.llm.common import read_table, training_fold

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op8_line_dedup", line_dedup.ORACLE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read_table(spark, sf_dir, "documents"), sites=line_dedup.SITES, counts=True)
    return found.select("doc_id", "n_lines", "n_removed", "text")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return found.select("doc_id", (~training_fold()).alias("held_out"), "score", predicted.alias("predicted"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece_codec.encode(docs, sentencepiece_codec.load(sentencepiece_codec.public_model()), verify=True)
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "restored")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op7_order_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(read_table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = quality.scores(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return found.select("doc_id", (~training_fold()).alias("held_out"), "score", predicted.alias("predicted"))


@query("op4_warc", warc.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a site's folder, a language's below it, and one for each thousand ids below that."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000), F.concat("doc_id", F.lit(".txt")))
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")), file_id="doc_id")
    return found.withColumnRenamed("file_id", "doc_id")


@query("op11_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, bpe.public_vocabulary())
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    found = alignment.report(docs, *alignment.public_paths(), instead={"groups_sha256": digest})
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_hard_negatives", hard_negatives.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))
