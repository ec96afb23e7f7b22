"""Contracts that operators keep: validated joins, unchanged identity, unique keys, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import passes


class ContractError(ValueError):
    """Data breaks a contract of an operator."""


def violations(df: DataFrame, checks: dict[str, Column]) -> dict[str, int]:
    """How many rows break each condition, in one pass; null counts as broken."""
    return df.agg(*(F.count_if(~passes(c)).alias(k) for k, c in checks.items())).first().asDict()


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    if bad := {k: n for k, n in violations(df, checks).items() if n}:
        raise ContractError(f"rows that break contracts: {bad}")
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ContractError(f"repeated keys: {list(keys)}")
    return df


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join that can't duplicate rows of the left side: the right side's keys are proved unique first."""
    return left.join(require_unique(right, on), list(on), how)


def compare_identity(before: DataFrame, after: DataFrame, key: str, immutable: Sequence[str]) -> DataFrame:
    """lost, added, changed: what an enrichment did to row identity and to fields that it must not touch."""
    a = before.select(F.col(key).alias("k"), F.struct(*immutable).alias("v"), F.lit(1).alias("was"))
    b = after.select(F.col(key).alias("k2"), F.struct(*immutable).alias("v2"), F.lit(1).alias("now"))
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    return both.agg(F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull() & ~F.col("v").eqNullSafe(F.col("v2"))).alias("changed"), F.count(F.lit(1)).alias("rows"))


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A digest of rows that doesn't depend on their order: count, sum and exclusive or of row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def same_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left_only, right_only, shared: key sets compared in both directions."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
