"""Closed-form corrections and Spark ML offset models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, finite
from .windows import effective_dates


def normal_equations(df: DataFrame, features: Sequence[Column], target: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy in one aggregation: a row of p * (p + 3) / 2 sums comes to the driver."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*(F.sum(weight * features[i] * features[j]).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(weight * features[i] * target).alias(f"b{i}") for i in range(p))).first()
    a = np.zeros((p, p))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(p)])


def ridge(df: DataFrame, features: Sequence[Column], target: Column, weight: Column, alpha: float) -> np.ndarray:
    """Weighted ridge coefficients without intercept; exact."""
    a, b = normal_equations(df, features, target, weight)
    return np.linalg.solve(a + alpha * np.eye(len(b)), b)


def standardised(df: DataFrame, columns: Sequence[str], weight: str) -> list[Column]:
    """Columns less their weighted mean over their weighted deviation (1 where that vanishes)."""
    w = F.col(weight)
    row = df.agg(*(x for c in columns for x in ((F.sum(w * F.col(c)) / F.sum(w)).alias(f"{c}|m"), (F.sum(w * F.col(c) * F.col(c)) / F.sum(w)).alias(f"{c}|s")))).first()
    out = []
    for c in columns:
        mean = row[f"{c}|m"]
        deviation = max(0.0, row[f"{c}|s"] - mean**2) ** 0.5
        out.append((F.col(c) - mean) / (deviation if deviation >= 1e-8 else 1.0))
    return out


def linear(features: Sequence[Column], coefficients: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for f, c in zip(features, coefficients, strict=True):
        out = out + f * float(c)
    return out


def shrunk_correction(raw: Column, supported: Column, shrink: float, cap: float) -> Column:
    """Shrunk and clipped where supported, exactly 0 elsewhere."""
    return F.when(F.coalesce(supported, F.lit(False)), clip(raw * shrink, -cap, cap)).otherwise(0.0)


def gated_correction(df: DataFrame, active: Column, terms: Sequence[Column], residual: Column, *, alpha: float, cap: float) -> Column:
    """A ridge of the residual on standardised terms, fitted on active rows, as a column: clipped to the cap where active, 0
    elsewhere. Two aggregations over the active rows; the intercept is not penalised. A row of which a term or the residual
    isn't finite is not fitted; its correction is 0 unless its terms are known. Without a row to fit there is no correction."""
    known = F.lit(True)
    for t in terms:
        known = known & finite(t.cast("double"))
    fitted = df.filter(active & known & finite(residual.cast("double")))
    row = fitted.agg(F.avg(residual).alias("base"), *(x for k, t in enumerate(terms) for x in (F.avg(t).alias(f"u{k}"), F.stddev_pop(t).alias(f"s{k}")))).first()
    if row["base"] is None:
        return F.lit(0.0)
    scaled = [(t - row[f"u{k}"]) / max(row[f"s{k}"], 1e-8) for k, t in enumerate(terms)]
    raw = linear(scaled, ridge(fitted, scaled, residual - row["base"], F.lit(1.0), alpha)) + row["base"]
    return F.when(F.coalesce(active & known, F.lit(False)), clip(raw, -cap, cap)).otherwise(0.0)


def scalar_shrink(df: DataFrame, keys: Sequence[str], weight: str, difference: Column, error: Column, date: str, regularisation: float = 20.0, min_dates: int = 6) -> DataFrame:
    """gamma = N * sum(w d e) / (N * sum(w d d) + regularisation) within [0, 1], N the effective dates of each group's
    normalised weights; 0 with too few dates."""
    keys = list(keys)
    daily = df.groupBy(*keys, date).agg(F.sum(weight).alias("m"), F.sum(F.col(weight) * difference * error).alias("de"), F.sum(F.col(weight) * difference * difference).alias("dd"), F.count(F.lit(1)).alias("k"))
    g = daily.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum("de").alias("de"), F.sum("dd").alias("dd"), F.count(F.lit(1)).alias("dates"), F.sum("k").alias("rows"))
    n = F.pow(F.col("m"), 2.0) / F.col("mm")
    raw = n * F.col("de") / F.col("m") / (n * F.col("dd") / F.col("m") + regularisation)
    fitted = F.col("dates") >= min_dates
    return g.select(*keys, "rows", "dates", n.alias("effective_dates"), raw.alias("unbounded_gamma"), F.when(fitted, clip(raw, 0.0, 1.0)).otherwise(0.0).alias("gamma"), F.when(fitted, "fitted").otherwise("unsupported_identity_fallback").alias("status"))


def feature_gate(df: DataFrame, features: Sequence[str]) -> int:
    """How many rows have a value that isn't finite; a model's caller refuses the batch if any."""
    bad = F.lit(False)
    for c in features:
        bad = bad | ~finite(F.col(c).cast("double"))
    return df.filter(bad).count()


def offset_pipeline(features: Sequence[str], category: str, label: str, weight: str, kind: str = "linear", **options):
    """Spark ML pipeline of an offset model: linear (ridge), trees (gradient boosting) or forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    filled = [f"{c}__filled" for c in features]
    index = StringIndexer(inputCol=category, outputCol="__index", handleInvalid="keep", stringOrderType="alphabetAsc")
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), index]
    if kind == "linear":
        stages += [OneHotEncoder(inputCol="__index", outputCol="__hot", handleInvalid="keep"), VectorAssembler(inputCols=[*filled, "__hot"], outputCol="__x")]
        model = LinearRegression(featuresCol="__x", labelCol=label, weightCol=weight, elasticNetParam=0.0, **{"regParam": 0.01, **options})
    else:
        stages.append(VectorAssembler(inputCols=[*filled, "__index"], outputCol="__x"))
        model = {"trees": GBTRegressor, "forest": RandomForestRegressor}[kind](featuresCol="__x", labelCol=label, weightCol=weight, seed=11, **options)
    return Pipeline(stages=[*stages, model])


def out_of_fold(df: DataFrame, fold: str, folds: int, pipeline) -> DataFrame:
    """Each row predicted once, by the model that didn't see its fold."""
    out = None
    for k in range(folds):
        part = pipeline.fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k)).select(*df.columns, F.col("prediction").alias("oof_prediction"))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["effective_dates", "feature_gate", "gated_correction", "linear", "normal_equations", "offset_pipeline", "out_of_fold", "ridge", "scalar_shrink", "shrunk_correction", "standardised"]
