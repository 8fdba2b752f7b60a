"""The corpus pipeline: documents in, piece ids of the clean and distinct documents out.

Each stage takes the documents that its predecessor kept, written as Parquet below ``spark.checkpoint.dir`` and read
again, so that a lost executor never costs more than a stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tranche.llm import decontamination, line_dedup, sentencepiece_codec, simhash, toxicity
from tranche.llm.common import read_table, written_once


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The lexicon is learnt from the labelled training rows of all documents."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.acceptable(docs, model, threshold=0.7)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sites, of over 50 words on three or more, stay at their first place only; every document stays."""
    return line_dedup.dedup(docs, long_sites=line_dedup.LONG_SITES)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within two bits, that with the smallest id stays."""
    return simhash.one_of_each(docs, words=3, distance=2)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within one edit in twenty characters go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, piece ids, their number, and whether decoding them gives the text again."""
    vocabulary = sentencepiece_codec.load(sentencepiece_codec.public_model())
    found = sentencepiece_codec.encode(docs, vocabulary, verify=True)
    return found.selectExpr("doc_id", "lang", "source", "cast(size(pieces) as long) as n_pieces", "pieces", "restored")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("near-duplicates", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("piece encoding", as_pieces),
]

#: Fingerprints, learnt lexicons and piece ids have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
