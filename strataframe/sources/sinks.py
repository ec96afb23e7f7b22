"""Writers: immutable tables, disjoint kinds, metric files, resumable parts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Fails if the path exists."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def fan_out(df: DataFrame, path: str, kind: str, allowed: Sequence[str]) -> dict[str, int]:
    """One folder for each kind; the counts read back must add up to the input's."""
    write_once(df, path, [kind])
    counts = {r[0]: r[1] for r in df.sparkSession.read.parquet(path).groupBy(kind).count().collect()}
    if sum(counts.values()) != df.count() or set(counts) - set(allowed):
        raise ContractError(f"kinds do not add up: {counts}")
    return counts


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def signature(options: dict) -> str:
    return json.dumps(options, sort_keys=True, separators=(",", ":"))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str], options: dict) -> DataFrame:
    """Rows whose key isn't done yet; finished parts made with other options are refused."""
    if done.filter(F.col("signature") != signature(options)).limit(1).count():
        raise ContractError("finished parts were made with other options")
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_parts(df: DataFrame, path: str, keys: Sequence[str], options: dict) -> None:
    df.withColumn("signature", F.lit(signature(options))).write.mode("append").partitionBy(*keys).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
