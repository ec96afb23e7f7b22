"""Grouped-aggregate functions over Arrow batches, to hold the distributed metrics against on groups of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError
from .metrics import weighted_quantile_radius


def grouped_radius(df: DataFrame, keys: Sequence[str], error: str, weight: str, level: float, most_rows: int = 1_000_000) -> DataFrame:
    """keys, radius: the weighted quantile of absolute errors, each group's rows in one function call. A group with more than
    ``most_rows`` rows is an error: such groups are for ``metrics.weighted_quantile_radius``."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_rows).limit(1).collect()
    if large:
        raise ContractError(f"the group {large[0].asDict()} has more than {most_rows} rows; take metrics.weighted_quantile_radius")

    @F.pandas_udf("double")
    def radius(errors: pd.Series, weights: pd.Series) -> float:
        known = errors.notna() & weights.notna()
        sums = weights[known].groupby(errors[known].abs()).sum().cumsum()
        if sums.empty:
            return None
        reached = sums[sums >= level * sums.iloc[-1] - 1e-12]
        return float(reached.index[0] if len(reached) else sums.index[-1])

    return df.groupBy(*keys).agg(radius(F.col(error).cast("double"), F.col(weight).cast("double")).alias("radius"))


def both_radii(df: DataFrame, keys: Sequence[str], error: str, weight: str, level: float, most_rows: int = 1_000_000) -> DataFrame:
    """keys, radius (distributed), grouped_radius, agree."""
    one = weighted_quantile_radius(df, keys, error, weight, level)
    two = grouped_radius(df, keys, error, weight, level, most_rows).withColumnRenamed("radius", "grouped_radius")
    return one.join(two, list(keys)).withColumn("agree", F.col("radius").eqNullSafe(F.col("grouped_radius")))
