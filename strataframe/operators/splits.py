"""Leakage-safe splits and admission of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_reason, ladder, passes
from .contracts import ContractError


def assign_splits(df: DataFrame, day: Column, held: Column, train_end: str, calibration_end: str) -> DataFrame:
    """Held regions first, then whole days: train and calibration periods include their last day."""
    periods = [(day <= F.to_date(F.lit(train_end)), ("train", "training_dates")), (day <= F.to_date(F.lit(calibration_end)), ("calibration", "calibration_dates"))]
    return df.withColumns({"split": ladder([(held, "test_region"), *((c, v[0]) for c, v in periods)], "test_temporal"), "time_period": ladder([(c, v[1]) for c, v in periods], "future_dates")})


def overlay_splits(df: DataFrame, temporal: Column, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """The temporal partition, overlaid by ordered reserved roles."""
    return df.withColumn("temporal_partition", temporal).withColumn("split", F.coalesce(first_reason(rules), F.col("temporal_partition")))


def crossing(df: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """Keys whose rows lie in more than one split."""
    return df.groupBy(*keys).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def validate_splits(df: DataFrame, split: str, day: str, minima: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows and days of each split against the least allowed; raises nothing, so that a report can be kept."""
    need = F.create_map(*(F.lit(x) for k, v in minima.items() for x in (k, v[0]))), F.create_map(*(F.lit(x) for k, v in minima.items() for x in (k, v[1])))
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("days"))
    return counts.withColumn("supported", (F.col("rows") >= F.coalesce(need[0][F.col(split)], F.lit(0))) & (F.col("days") >= F.coalesce(need[1][F.col(split)], F.lit(0))))


def admit(df: DataFrame, rules: Sequence[tuple[Column, str]], fit_rules: Sequence[tuple[Column, str]] = (), evaluation_rules: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Every row stays. ``reason``: the first check that a row fails (a check that is null fails it); ``fit_reason`` and
    ``evaluation_reason`` go on with their own; ``kind``: fit, evaluation, both or excluded."""
    reason = first_reason([(~passes(c), label) for c, label in rules])
    out = df.withColumn("reason", reason)
    out = out.withColumn("fit_reason", F.coalesce("reason", first_reason([(~passes(c), label) for c, label in fit_rules]) if fit_rules else F.lit(None)))
    out = out.withColumn("evaluation_reason", F.coalesce("reason", first_reason([(~passes(c), label) for c, label in evaluation_rules]) if evaluation_rules else F.lit(None)))
    fit, evaluation = F.col("fit_reason").isNull(), F.col("evaluation_reason").isNull()
    return out.withColumn("kind", F.when(fit & evaluation, "both").when(fit, "fit").when(evaluation, "evaluation").otherwise("excluded"))


def independent_failures(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """How many rows fail each check on its own, next to how many have it as first reason: one pass."""
    first = first_reason([(~passes(c), label) for c, label in rules])
    one = df.withColumn("__first", first).agg(*(F.count_if(~passes(c)).alias(f"{label}|all") for c, label in rules), *(F.count_if(F.col("__first") == label).alias(f"{label}|first") for _, label in rules))
    rows = F.array(*(F.struct(F.lit(label).alias("reason"), F.col(f"`{label}|all`").alias("failures"), F.col(f"`{label}|first`").alias("first_reason_rows")) for _, label in rules))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def area_blocks(areas: DataFrame, extent: Sequence[str], size: float, held: int = 5) -> DataFrame:
    """row, col, west, south, east, north and spatial_holdout of the blocks that cover each area's extent (x0, y0, x1, y1), cut at
    its edges: one block in ``held`` is held out, in a pattern that no row or column escapes. An extent without a size, or with a
    null, has no block."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in extent)
    whole = areas.filter((x1 > x0) & (y1 > y0))
    steps = lambda a, b: F.sequence(F.lit(0), (F.ceil((b - a) / size) - 1).cast("int"))
    blocks = whole.withColumn("row", F.explode(steps(y0, y1))).withColumn("col", F.explode(steps(x0, x1)))
    west, south = x0 + F.col("col") * size, y0 + F.col("row") * size
    edges = {"west": west, "south": south, "east": F.least(west + size, x1), "north": F.least(south + size, y1)}
    return blocks.withColumns({**edges, "spatial_holdout": (F.col("row") + 2 * F.col("col")) % held == 0})


def require_disjoint(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of parts with their name; a key in two parts, or twice in one, is an error."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("kind", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if not out.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ContractError(f"parts share keys {list(keys)}")
    return out


def manifest_union(items: DataFrame, key: str, digest: str, status: str, allowed: Sequence[str]) -> DataFrame:
    """failed outcomes aside; identical repeats collapse; differing repeats and unknown statuses are marked."""
    known = items.withColumn("__known", F.col(status).isin(*allowed))
    return known.groupBy(key).agg(F.count_distinct(F.when(F.col(status) == "complete", F.col(digest))).alias("versions"), F.min(F.when(F.col(status) == "complete", F.col(digest))).alias("digest"), F.count_if(~F.col("__known")).alias("unknown"), F.count_if(F.col(status) == "failed").alias("failed")).withColumn("outcome", ladder([(F.col("unknown") > 0, "unknown_status"), (F.col("versions") > 1, "conflict"), (F.col("versions") == 1, "accepted")], "failed_only"))
