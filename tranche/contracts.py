"""Data contracts: one aggregate pass per set of checks, one row per contract.

Operators guard single values inside their own plan (``functions.guards``). The checks
here look at whole tables: keys, row counts, schemas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.functions.shape import record, rows_of


class ContractViolation(ValueError):
    """Raised by :func:`enforce` when a contract has violations."""


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(contract, violations): how many rows break each boolean ``check`` (null counts as broken)."""
    counts = [F.count_if(~F.coalesce(check, F.lit(False))).alias(name) for name, check in checks.items()]
    return rows_of(df.agg(*counts), [], [record(contract=n, violations=F.col(f"`{n}`")) for n in checks])


def unique_key(df: DataFrame, *key: str) -> DataFrame:
    """Number of key values that occur more than once."""
    repeats = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return repeats.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
        F.lit(f"unique_key({','.join(key)})").alias("contract"), "violations"
    )


def same_keys(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys found on one side only, one row per direction."""
    key = list(key)
    both = (
        left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .agg(
            F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("missing"),
            F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("extra"),
        )
    )
    return rows_of(
        both,
        [],
        [
            record(contract="keys_missing_on_right", violations=F.col("missing")),
            record(contract="keys_missing_on_left", violations=F.col("extra")),
        ],
    )


def row_count_kept(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, rows_before, rows_after, violations) - the row difference per group."""
    counted = before.select(by, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(by, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return (
        counted.groupBy(by)
        .agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))
        .withColumn("violations", F.abs(F.col("rows_after") - F.col("rows_before")))
    )


def all_of(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def enforce(result: DataFrame) -> None:
    """Raise when any contract of ``result`` is broken (collects one row per contract)."""
    broken = result.filter(F.col("violations") > 0).collect()
    if broken:
        raise ContractViolation("; ".join(str(r.asDict()) for r in broken))


def same_columns(left: DataFrame, right: DataFrame, ordered: bool = False) -> None:
    a, b = list(left.columns), list(right.columns)
    if (a != b) if ordered else (set(a) != set(b)):
        raise ContractViolation(f"columns differ: {sorted(set(a) ^ set(b)) or 'order'}")


def observed_write(
    df: DataFrame, path: str, checks: dict[str, Column], key: str | None = None, counts: dict[str, Column] | None = None, name: str = "write"
) -> dict:
    """Write ``df`` as parquet to ``path`` and return the write's own metrics; fail it where a check is broken.

    The metrics are observed on the rows as they are written (``DataFrame.observe``), so they cost no job of their
    own: ``rows``, ``key_nulls`` (with ``key``) and, for every boolean ``check``, the number of rows that break it
    (null counts as broken); ``counts`` are further aggregates, observed and returned but not enforced. Files go to a staging folder beside ``path`` and are renamed to ``path`` only when no
    check is broken; otherwise the staging folder stays (for a look) and ``ContractViolation`` is raised.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if key is not None:
        metrics.append(F.count_if(F.col(key).isNull()).alias("key_nulls"))
    metrics += [F.count_if(~F.coalesce(check, F.lit(False))).alias(n) for n, check in checks.items()]
    metrics += [aggregate.alias(n) for n, aggregate in (counts or {}).items()]
    staging = path.rstrip("/") + "._staging"
    df.observe(seen, *metrics).write.parquet(staging)
    got = dict(seen.get)
    broken = {n: got[n] for n in checks if got[n]}
    if key is not None and got["key_nulls"]:
        broken["key_nulls"] = got["key_nulls"]
    if broken:
        raise ContractViolation(f"write to {path} broke {broken}; files kept in {staging}")
    jvm = df.sparkSession._jvm
    source = jvm.org.apache.hadoop.fs.Path(staging)
    system = source.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if not system.rename(source, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"could not publish {staging} as {path}")
    return got
