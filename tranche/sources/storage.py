"""CSV, parquet and model storage."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.functions.shape import local_table

# Keys the validation stage expects beside a model.
REQUIRED_METADATA = [
    "selected_model",
    "model_family",
    "preprocessing_branch",
    "target_column",
    "row_identifier",
    "train_data_path",
    "test_data_path",
]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema when there is one (no extra pass), else with inferred types."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_layer(df: DataFrame, path: str, split: str = "split") -> None:
    """One parquet layer, a folder per split, so reading one split skips the other."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_layer(spark: SparkSession, path: str, split_value: str | None = None, split: str = "split") -> DataFrame:
    layer = spark.read.parquet(path)
    return layer.filter(F.col(split) == split_value) if split_value else layer


def _metadata_path(path: str) -> str:
    return f"{path.rstrip('/')}.metadata.json"


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict) -> str:
    """Model folder plus a sibling JSON record. The row identifier is always written."""
    if not path.strip():
        raise ValueError("path must not be empty")
    model.write().overwrite().save(path)
    record = {"row_identifier": "row_id", **metadata}
    line = local_table(spark, [{"value": json.dumps(record, sort_keys=True)}], "value string")
    line.coalesce(1).write.mode("overwrite").text(_metadata_path(path))
    return path


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata record as a one-row table."""
    return spark.read.option("multiLine", True).json(_metadata_path(path))


def missing_metadata(metadata: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(key): required keys that the record does not have."""
    spark = metadata.sparkSession
    wanted = local_table(spark, [{"key": k} for k in required or REQUIRED_METADATA], "key string")
    present = local_table(spark, [{"key": c} for c in metadata.columns], "key string")
    return wanted.join(present, "key", "left_anti")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, list[str]]:
    """Model, metadata record, and the required keys that are missing from it."""
    metadata = load_metadata(spark, path)
    return PipelineModel.load(path), metadata, sorted(r.key for r in missing_metadata(metadata).collect())
