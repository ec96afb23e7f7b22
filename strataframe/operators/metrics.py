"""Error metrics, calibrated intervals, acceptance, summaries. Segments without rows are the caller's registry join."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import first_reason
from ..store import written
from .joins import registry_outer
from .windows import _back


def error_metrics(error: Column) -> list[Column]:
    return [F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias")]


def balanced_metrics(error: Column, weight: Column, digits: int) -> list[Column]:
    """Weighted error, root mean square and bias of a group whose weights add up to 1."""
    parts = {"mae": F.sum(weight * F.abs(error)), "rmse": F.sqrt(F.sum(weight * error * error)), "bias": F.sum(weight * error)}
    return [F.round(v, digits).alias(k) for k, v in parts.items()]


def weighted_metrics(df: DataFrame, segment: Sequence[str], error: str, weight: str, acquisition: Sequence[str], date: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Weighted error block of each segment. Weights add up to 1 in a segment; the contrast is the mean absolute error
    after each acquisition's weighted mean error is taken off."""
    keys = list(segment)
    mean = df.groupBy(*keys, *acquisition).agg((F.sum(F.col(error) * F.col(weight)) / F.sum(weight)).alias("__mean"))
    joined = df.join(mean, [*keys, *acquisition])
    w, e = F.col(weight), F.col(error)
    over = [F.sum(w * F.when(F.abs(e) > t, 1.0).otherwise(0.0)).alias(f"fraction_gt_{t:g}") for t in thresholds]
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(*date).alias("date_count"), F.count_distinct(*acquisition).alias("acquisition_count"),
        F.sum(w * F.abs(e)).alias("mae"), F.sqrt(F.sum(w * e * e)).alias("rmse"), F.sum(w * e).alias("bias"), *over, F.sum(w * F.abs(e - F.col("__mean"))).alias("contrast_mae"), F.avg(F.abs(e)).alias("unweighted_mae"),
    ).withColumn("status", F.when(F.col("date_count") >= 2, "exploratory").otherwise("unsupported_single_date"))


def _segments(families: dict[str, Sequence[str]]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("segment_type"), (F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)) if cols else F.lit("all")).alias("segment")) for name, cols in families.items()))


def explode_segments(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """A row for each grouping family that a row belongs to, as (segment_type, segment)."""
    return df.select("*", F.explode(_segments(families)).alias("__s")).select("*", "__s.segment_type", "__s.segment").drop("__s")


def segment_means(df: DataFrame, families: dict[str, Sequence[str]], levels: Sequence[Sequence[str]], keys: Sequence[str], totals: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """keys, segment_type, segment, n, the totals (sums over rows) and the means, each nested by level: the mean over a segment's
    groups of the first level of the means over a group's children, and so on down to the mean over rows. That is what balanced
    weights give, without a weight. A mean leaves out the rows in which it is null, and groups and children without any other.

    Rows are shuffled once, to their group and its child (a region's day, say); there they are added up and averaged level by
    level, so only groups travel again. Segments of whole groups share their groups' means: there, a row is copied once for all
    of those families and once for every other family."""
    keys = list(keys)
    columns = list(dict.fromkeys([*(c for cols in families.values() for c in cols), *(c for level in levels for c in level)]))
    whole = {name: cols for name, cols in families.items() if set(cols) <= set(levels[0])}
    parts = {name: cols for name, cols in families.items() if name not in whole}
    values = {k: v.alias(f"__{k}") for k, v in means.items()}
    rows = df.select(*keys, *columns, *(v.alias(k) for k, v in totals.items()), *values.values())
    rows = rows.repartition(*keys, *dict.fromkeys(c for level in levels[:2] for c in level))
    shared = F.array(F.struct(F.lit(None).cast("string").alias("segment_type"), F.lit(None).cast("string").alias("segment"))) if whole else None
    copies = F.concat(*([shared] if whole else []), *([_segments(parts)] if parts else []))
    up = rows.select("*", F.lit(1).cast("long").alias("n"), F.explode(copies).alias("__s")).select("*", "__s.segment_type", "__s.segment")
    segment = [*keys, "segment_type", "segment"]
    parents = [segment]
    for level in levels:
        parents.append([*parents[-1], *(c for c in level if c not in parents[-1])])
    added = [F.sum(k).alias(k) for k in ("n", *totals)]
    always = {k for k in means if not rows.schema[f"__{k}"].nullable}  # these share one count of children
    mean_of = [(F.sum(f"__{k}") / F.count(F.lit(1)) if k in always else F.avg(f"__{k}")).alias(f"__{k}") for k in means]
    for parent in parents[:0:-1]:
        up = up.groupBy(*parent).agg(*added, *mean_of)
    own = F.array(F.struct("segment_type", "segment"))
    up = up.select("*", F.explode(F.when(F.col("segment_type").isNull(), _segments(whole)).otherwise(own) if whole else own).alias("__s")).drop("segment_type", "segment").select("*", "__s.*")
    return up.groupBy(*segment).agg(*added, *mean_of).withColumnsRenamed({f"__{k}": k for k in means})


def _acquisition_sums(rows: DataFrame, levels: Sequence[Sequence[str]], segment: Sequence[str], acquisition: Sequence[str], value: Column, broadcast_rows: int = 100_000) -> DataFrame:
    """Of each group of the first level within the segment, and each acquisition: the sum of its balanced weights (but for a
    factor of the segment) and of weights times values. Cells down to the acquisition are averaged where their group and day are."""
    parents = [list(segment)]
    for level in levels:
        parents.append([*parents[-1], *(c for c in level if c not in parents[-1])])
    depth = next(i for i, p in enumerate(parents) if set(acquisition) <= set(p))
    cells = rows.repartition(*parents[min(2, depth)]).groupBy(*parents[-1]).agg(F.avg(value).alias("__value"))
    for parent in parents[-2 : depth - 1 : -1]:
        cells = cells.groupBy(*parent).agg(F.avg("__value").alias("__value"))
    cells = cells.withColumn("__weight", 1.0 / (F.count(F.lit(1)).over(Window.partitionBy(*parents[depth - 1])) if depth > 1 else F.lit(1)))
    for i in range(depth - 2, 0, -1):
        counts = written(rows.select(*parents[i + 1]).distinct().groupBy(*parents[i]).agg(F.count(F.lit(1)).alias("__children")), "children")
        cells = _back(cells, F.broadcast(counts) if counts.count() <= broadcast_rows else counts, parents[i])
        cells = cells.withColumn("__weight", F.col("__weight") / F.col("__children")).drop("__children")
    sums = cells.groupBy(*dict.fromkeys([*parents[1], *acquisition])).agg(F.sum("__weight").alias("__weight"), F.sum(F.col("__weight") * F.col("__value")).alias("__value"))
    return written(sums, "acquisitions")


def segment_blocks(df: DataFrame, families: dict[str, Sequence[str]], levels: Sequence[Sequence[str]], error: str, acquisition: Sequence[str], date: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """The block of ``weighted_metrics`` of every segment of every family, with balanced weights within the segment, without a
    row for a family. All of it are means nested by level. The contrast's are taken of each error beside its acquisition's mean in
    the segment; segments of whole groups of the first level whose columns split acquisitions alike have the same such mean."""
    columns = dict.fromkeys([*(c for cols in families.values() for c in cols), *(c for level in levels for c in level), *acquisition, *date])
    parts = {name: f"__in_{name}" for name, cols in families.items() if not set(cols) <= set(levels[0])}
    labels = {mark: _segments({name: families[name]})[0]["segment"] for name, mark in parts.items()}
    rows = written(df.select(*columns, F.col(error).alias("__e")).withColumns(labels), "rows")
    e = F.coalesce("__e", F.lit(0.0))
    shares = {mark: _acquisition_sums(rows, levels, [mark] if mark else [], acquisition, e) for mark in dict.fromkeys(parts.get(name) for name in families)}
    kinds: dict[tuple[str, ...], tuple[str, DataFrame]] = {}
    contrast_of, acquisitions = {}, []
    joined = rows
    for name, cols in families.items():
        mark = parts.get(name)
        keys = (*acquisition, *([mark] if mark else sorted(set(cols) - set(acquisition))))
        if keys not in kinds:
            mean = f"__mean{len(kinds)}"
            table = shares[mark].groupBy(*keys).agg((F.sum("__value") / F.sum("__weight")).alias(mean))
            joined = _back(joined, table, keys)
            kinds[keys] = mean, table
        contrast_of[name] = kinds[keys][0]
        segment = F.col(mark) if mark else _segments({name: cols})[0]["segment"]
        acquisitions.append(kinds[keys][1].groupBy(F.lit(name).alias("segment_type"), segment.alias("segment")).agg(F.count_distinct(*acquisition).alias("acquisition_count")))
    counts = reduce(DataFrame.union, acquisitions)
    dates = explode_segments(rows.select(*dict.fromkeys([*(c for cols in families.values() for c in cols), *date])).distinct(), families).groupBy("segment_type", "segment").agg(F.count_distinct(*date).alias("date_count"))
    over = {f"fraction_gt_{t:g}": F.when(F.abs(e) > t, 1.0).otherwise(0.0) for t in thresholds}
    contrasts = {mean: F.coalesce(F.abs(F.col("__e") - F.col(mean)), F.lit(0.0)) for mean, _ in kinds.values()}
    means = segment_means(joined, families, levels, [], {"__abs": F.abs("__e"), "__known": F.when(F.col("__e").isNotNull(), 1).otherwise(0)}, {"mae": F.abs(e), "__square": e * e, "bias": e, **over, **contrasts})
    contrast = F.coalesce(*(F.when(F.col("segment_type") == name, F.col(mean)) for name, mean in contrast_of.items()))
    out = means.join(dates, ["segment_type", "segment"]).join(counts, ["segment_type", "segment"])
    return out.select(
        "segment_type", "segment", "n", "date_count", "acquisition_count", "mae", F.sqrt("__square").alias("rmse"), "bias", *over, contrast.alias("contrast_mae"), F.try_divide("__abs", "__known").alias("unweighted_mae"),
        F.when(F.col("date_count") >= 2, "exploratory").otherwise("unsupported_single_date").alias("status"),
    )


def date_balanced(df: DataFrame, keys: Sequence[str], date: str, error: str, thresholds: Sequence[float] = (5, 7)) -> DataFrame:
    """Means within each date, then over dates, next to plain means over rows; rows without a finite error are left out."""
    e = F.col(error)
    parts = {"mae": F.abs(e), "bias": e, **{f"gt{t:g}": F.when(F.abs(e) > t, 1.0).otherwise(0.0) for t in thresholds}}
    daily = df.filter(e.isNotNull() & ~F.isnan(e)).groupBy(*keys, date).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(v).alias(f"__{k}") for k, v in parts.items()))
    return daily.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("dates"), *(F.avg(F.col(f"__{k}") / F.col("__n")).alias(f"date_{k}") for k in parts), *((F.sum(f"__{k}") / F.sum("__n")).alias(f"pixel_{k}") for k in parts))


#: Fixed: reasons of an acceptance receipt, in their order; those of quarters come last.
REASONS = ("missing_group", "insufficient_reference_rows", "insufficient_independent_dates", "insufficient_seasonal_dates", "missing_predictions", "training_overlap", "mae_target_or_coverage_failed")


def acceptance(rows: DataFrame, registry: DataFrame, keys: Sequence[str], date: str, quarter: str, error: str, leaked: str, *, target: float, min_rows: int, min_dates: int, min_quarter_dates: int) -> DataFrame:
    """A receipt for each required group: counts, coverage, dates by quarter, metrics, all reasons of failure in order, and
    whether it passed. Groups without rows fail with 'missing_group'.

    One pass: rows are added up by date, dates by quarter, quarters by group.
    """
    keys, e = list(keys), F.col(error)
    good = e.isNotNull() & ~F.isnan(e)
    daily = rows.groupBy(*keys, quarter, date).agg(F.count(F.lit(1)).alias("__n"), F.count(e).alias("__p"), F.max(F.col(leaked).cast("int")).alias("__leaked"), F.count_if(good).alias("__k"), F.sum(F.when(good, F.abs(e))).alias("__s"), F.sum(F.when(good, e)).alias("__t"))
    by_quarter = daily.groupBy(*keys, quarter).agg(
        *(F.sum(f"__{c}").alias(f"__{c}") for c in "npkst"), F.count(date).alias("__dates"), F.max("__leaked").alias("__leaked"), F.count_if(F.col("__k") > 0).alias("__d"),
        F.sum(F.col("__s") / F.nullif(F.col("__k"), F.lit(0))).alias("__sd"), F.sum(F.col("__t") / F.nullif(F.col("__k"), F.lit(0))).alias("__td"),
    )
    late = (F.col("__sd") / F.nullif(F.col("__d"), F.lit(0)) > target) | (F.col("__s") / F.nullif(F.col("__k"), F.lit(0)) > target)
    whole = by_quarter.groupBy(*keys).agg(
        F.sum("__n").alias("reference_rows"), F.sum("__p").alias("predicted_rows"), F.sum("__dates").alias("independent_dates"), F.max("__leaked").alias("__leaked"), *(F.coalesce(F.sum(F.when(F.col(quarter) == q, F.col("__dates"))), F.lit(0)).alias(f"q{q}_dates") for q in range(1, 5)),
        (F.sum("__sd") / F.nullif(F.sum("__d"), F.lit(0))).alias("date_mae"), (F.sum("__s") / F.nullif(F.sum("__k"), F.lit(0))).alias("pixel_mae"), (F.sum("__td") / F.nullif(F.sum("__d"), F.lit(0))).alias("date_bias"),
        F.array_sort(F.collect_list(F.when(late, F.concat(F.lit("quarter_"), F.col(quarter), F.lit("_mae_target_failed"))))).alias("__late"),  # four at most
    )
    out = registry_outer(registry, whole, keys, ["reference_rows", "predicted_rows", "independent_dates", "__leaked", *(f"q{q}_dates" for q in range(1, 5))])
    n = F.col("reference_rows")
    point = F.coalesce((n > 0) & (F.col("predicted_rows") == n) & (F.col("date_mae") <= target) & (F.col("pixel_mae") <= target), F.lit(False))
    failed = [n == 0, n < min_rows, F.col("independent_dates") < min_dates, F.least(*(F.col(f"q{q}_dates") for q in range(1, 5))) < min_quarter_dates, F.col("predicted_rows") != n, F.col("__leaked") == 1, (n > 0) & ~point]
    reasons = F.concat(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(failed, REASONS, strict=True)))), F.coalesce(F.col("__late"), F.array().cast("array<string>")))
    return out.withColumns({"prediction_coverage": F.when(n > 0, F.col("predicted_rows") / n).otherwise(0.0), "point_target_met": point, "reasons": F.array_join(reasons, ";"), "passed": F.size(reasons) == 0}).drop("__leaked", "__late")


def order_bin(value: Column) -> Column:
    """Whole numbers in the order of the values; values of one number differ by less than 0.1 %."""
    size = F.floor(F.log2(F.abs(value)) * 1024)
    return F.when(value > 0, size).when(value < 0, -size - (1 << 41)).when(value == 0, F.lit(-(1 << 40))).cast("long")


def order_statistics(df: DataFrame, keys: Sequence[str], value: Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, for each name, the value of that rank from below (from 1, as a function of n); null where there is none.

    Two levels: counts by bins of nearly equal values are added up in each task; only the different values of the bins that
    hold a rank are then counted, again in each task first, and ordered. So a key with a third of all rows is neither sorted
    nor held in one task, and a value that a third of all rows share is a row a task.
    """
    keys = list(keys)
    rows = df.select(*keys, value.alias("__v"), order_bin(value).alias("__bin"))
    bins = rows.groupBy(*keys, "__bin").agg(F.count("__v").alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    placed = bins.withColumns({"__before": F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__c").over(Window.partitionBy(*keys))})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()))).alias("__r")
    picks = placed.select("*", wanted).filter((F.col("__r.rank") > F.col("__before")) & (F.col("__r.rank") <= F.col("__before") + F.col("__c"))).select(*keys, "__bin", "__r.name", (F.col("__r.rank") - F.col("__before")).alias("__k"))
    values = rows.join(picks.select(*keys, "__bin").distinct(), [*keys, "__bin"], "left_semi").groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__m"))
    inside = values.withColumn("__to", F.sum("__m").over(Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    held = (F.col("__k") > F.col("__to") - F.col("__m")) & (F.col("__k") <= F.col("__to"))
    found = inside.join(picks, [*keys, "__bin"]).filter(held).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks))
    return bins.groupBy(*keys).agg(F.sum("__c").alias("n")).join(found, keys, "left")


def quantile(df: DataFrame, keys: Sequence[str], value: Column, share: float, name: str) -> DataFrame:
    """keys, n and the quantile, interpolated between the two values around it."""
    at = lambda n: (n - 1) * share + 1
    both = order_statistics(df, keys, value, {"__lo": lambda n: F.floor(at(n)), "__hi": lambda n: F.ceil(at(n))})
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    return both.withColumn(name, F.col("__lo") + part * (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def order_radius(df: DataFrame, keys: Sequence[str], residual: str, coverage: float) -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest absolute residual; null where there are too few."""
    rank = lambda n: F.ceil((n + 1) * coverage)
    return order_statistics(df, keys, F.abs(residual), {"radius": rank}).withColumn("rank", rank(F.col("n")))


def weighted_quantile_radius(df: DataFrame, keys: Sequence[str], error: str, weight: str, level: float) -> DataFrame:
    """The first absolute error at which the running weight reaches ``level`` of the total: by bins first, then by the different
    errors of the bin in which it does, so equal errors are one row a task."""
    keys = list(keys)
    rows = df.select(*keys, F.abs(error).alias("__e"), F.col(weight).alias("__w"), order_bin(F.abs(error)).alias("__bin"))
    bins = rows.groupBy(*keys, "__bin").agg(F.sum("__w").alias("__bw"), F.max("__e").alias("__most"))
    w = Window.partitionBy(*keys).orderBy("__bin")
    placed = bins.withColumns({"__before": F.coalesce(F.sum("__bw").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "__goal": level * F.sum("__bw").over(Window.partitionBy(*keys)) - 1e-12})
    picks = placed.filter((F.col("__before") < F.col("__goal")) & (F.col("__before") + F.col("__bw") >= F.col("__goal")))
    values = rows.join(picks.select(*keys, "__bin"), [*keys, "__bin"], "left_semi").groupBy(*keys, "__bin", "__e").agg(F.sum("__w").alias("__w")).join(picks, [*keys, "__bin"])
    inside = values.withColumn("__run", F.col("__before") + F.sum("__w").over(Window.partitionBy(*keys, "__bin").orderBy("__e").rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__run") >= F.col("__goal"), F.col("__e"))), F.max("__e")).alias("__radius"))
    return bins.groupBy(*keys).agg(F.max("__most").alias("__most")).join(found, keys, "left").select(*keys, F.coalesce("__radius", "__most").alias("radius"))


def interval_coverage(df: DataFrame, keys: Sequence[str], value: str, low: str, high: str, weight: str | None = None) -> DataFrame:
    inside = F.when(F.col(value).between(F.col(low), F.col(high)), 1.0).otherwise(0.0)
    share = F.sum(F.col(weight) * inside) / F.sum(weight) if weight else F.avg(inside)
    return df.groupBy(*keys).agg(share.alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("mean_width"), F.count(F.lit(1)).alias("n"))


def tail_metrics(df: DataFrame, keys: Sequence[str], observed: str, error: str, hot: float, cold: float) -> DataFrame:
    e = F.abs(error)
    means = df.groupBy(*keys).agg(F.avg(F.when(F.col(observed) >= hot, e)).alias("hot_mae"), F.avg(F.when(F.col(observed) <= cold, e)).alias("cold_mae"))
    return means.join(quantile(df, keys, e, 0.9, "p90_abs_error"), list(keys), "left")


def support_counts(df: DataFrame, keys: Sequence[str], date: str, acquisition: str, fresh: Column, block: str, season: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(date).alias("dates"), F.count_distinct(acquisition).alias("acquisitions"), F.count_distinct(F.when(fresh, F.col(date))).alias("new_dates"), F.count_distinct(block).alias("blocks"), F.array_join(F.array_sort(F.collect_set(season)), ",").alias("seasons"))


def group_support(df: DataFrame, keys: Sequence[str], date: str, month: str, fold: str, min_dates: int = 6, min_months: int = 3, min_folds: int = 2) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count_distinct(date).alias("dates"), F.count_distinct(month).alias("months"), F.count_distinct(fold).alias("folds"))
    return counts.withColumn("supported", (F.col("dates") >= min_dates) & (F.col("months") >= min_months) & (F.col("folds") >= min_folds))


def feature_summary(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """min, max, mean and missing of each feature: one aggregation over all, then one row each."""
    out = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}|{k}") for c in numeric for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), *(F.count_if(F.col(c).isNull()).alias(f"{c}|missing") for c in numeric))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"`{c}|{k}`").alias(k) for k in ("min", "max", "mean", "missing"))) for c in numeric)))
    return out.select(rows.alias("r")).select("r.*")


def availability(df: DataFrame, dimensions: dict[str, Sequence[str]], kept: Column, date: str) -> DataFrame:
    """Rows and dates before and after a mask along several dimensions, in one grouping-sets pass."""
    columns = list(dict.fromkeys(c for cols in dimensions.values() for c in cols))
    sets = [[F.col(c) for c in cols] for cols in dimensions.values()]
    marks = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols) for name, cols in dimensions.items()}
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("original_rows"), F.count_if(kept).alias("retained_rows"), F.count_distinct(date).alias("original_dates"), F.count_distinct(F.when(kept, F.col(date))).alias("retained_dates"))
    label = F.concat_ws("|", *(F.when(F.bitwise_not(F.shiftright(F.col("g"), len(columns) - 1 - i)).bitwiseAND(F.lit(1).cast("long")) == 1, F.coalesce(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(columns)))
    name = F.coalesce(*(F.when(F.col("g") == v, F.lit(k)) for k, v in marks.items()))
    return grouped.select(name.alias("dimension"), label.alias("member"), "original_rows", "retained_rows", "original_dates", "retained_dates", (F.col("retained_rows") == 0).alias("lost_support"))


def bootstrap(daily: DataFrame, date: str, numerators: Sequence[str], denominator: str, draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Date-cluster bootstrap from per-date sums: every date gets a Poisson(1) multiplicity in each draw from its hash, the
    same for all models; percentiles of each ratio. Rows are dates times draws, never samples times draws."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(date), F.col("draw")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cumulative, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        cumulative.append((total, k))
        p /= k + 1
    times = F.coalesce(*(F.when(u <= c, F.lit(k)) for c, k in cumulative), F.lit(8))
    drawn = daily.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("m", times)
    sums = drawn.groupBy("draw").agg(*((F.sum(F.col("m") * F.col(c)) / F.sum(F.col("m") * F.col(denominator))).alias(c) for c in numerators))
    stacked = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in numerators))).alias("r")).select("r.*")
    return stacked.groupBy("metric").agg(F.percentile("v", low).alias("low"), F.percentile("v", high).alias("high"), F.avg("v").alias("mean"))


def gate(metrics: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Candidates with the first reason against each, if any."""
    return metrics.withColumn("rejected_for", first_reason(rules)).withColumn("accepted", F.col("rejected_for").isNull())


def near_best(candidates: DataFrame, score: str, margin: float, prefer: Sequence[Column]) -> DataFrame:
    """Among candidates within ``margin`` of the best, the first by preference."""
    best = candidates.agg(F.min(score)).first()[0]
    return candidates.filter(F.col(score) <= F.lit(best) + margin).orderBy(*prefer).limit(1)
