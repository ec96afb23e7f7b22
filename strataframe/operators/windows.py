"""Weights, history windows, ranks and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import epoch_hour
from ..store import written


def _counted(df: DataFrame, keys: Sequence[str], child: str, name: str) -> DataFrame:
    """How many different ``child`` values each key has. A plain aggregation that is joined back: it combines on the map
    side and has no key's rows in one task, as a window would."""
    return df.groupBy(*keys).agg(F.count_distinct(child).alias(name))


def _back(df: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A null-safe left join on the keys of the left side's rows."""
    right = counts.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *(c for c in counts.columns if c not in keys))
    return df.join(right, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], "left").drop(*(f"__of_{k}" for k in keys))


def balanced_weights(df: DataFrame, levels: Sequence[Sequence[str]], segment: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """Nested equal weights: each group of the first level has the same weight within a segment, each child of a group the
    same share of it, and so on down to rows; they add up to 1 in each segment.

    ``levels``: columns that each level adds. Weights depend on the segment, so they are taken within it.
    """
    parents = [list(segment)]
    for level in levels:
        parents.append([*parents[-1], *(c for c in level if c not in parents[-1])])
    # distinct keys of each level come from those of the level below; the lowest level's are written, so the rows are
    # aggregated once and joined once whatever the number of levels
    leaf = written(df.groupBy(*parents[-1]).agg(F.count(F.lit(1)).alias("__leaf")), "weights")
    below, table, product = leaf, leaf, F.col("__leaf").cast("double")
    for i in range(len(levels) - 1, -1, -1):
        count = F.count(F.lit(1)).alias(f"__n{i}")
        if parents[i]:
            below = below.groupBy(*parents[i]).agg(count)
            table = _back(table, below, parents[i])
            product = product * F.col(f"__n{i}")
        else:
            product = product * F.lit(float(below.agg(count).first()[0] or 1))
    return _back(df, table.select(*parents[-1], (1.0 / product).alias(name)), parents[-1])


def area_weights(df: DataFrame, group: Sequence[str], date: str, acquisition: str, area: str, name: str = "weight") -> DataFrame:
    """A cell's share of its acquisition's area, over acquisitions of the date, dates of the group, and groups."""
    groups = df.select(*group).distinct().count()
    dates = _counted(df, group, date, "__dates")
    acquisitions = _counted(df, [*group, date], acquisition, "__acquisitions")
    total = df.groupBy(*group, date, acquisition).agg(F.sum(area).alias("__total"))
    out = _back(_back(_back(df, dates, group), acquisitions, [*group, date]), total, [*group, date, acquisition])
    return out.withColumn(name, F.col(area) / F.col("__total") / F.col("__acquisitions") / F.col("__dates") / F.lit(groups)).drop("__dates", "__acquisitions", "__total")


def conservative_weights(df: DataFrame, weight: str, is_new: Column, group: Sequence[str], factor: float = 0.5) -> DataFrame:
    """New rows count ``factor``; each group then gets its former mass back."""
    changed = df.withColumn("__w", F.col(weight) * F.when(is_new, factor).otherwise(1.0))
    mass = changed.groupBy(*group).agg((F.sum(weight) / F.sum("__w")).alias("__scale"))
    return _back(changed, mass, group).withColumn(weight, F.col("__w") * F.col("__scale")).drop("__w", "__scale")


def effective_dates(df: DataFrame, weight: str, date: str) -> DataFrame:
    """1 / sum of squared date masses of normalised weights."""
    mass = df.groupBy(date).agg(F.sum(weight).alias("m"))
    return mass.agg((F.pow(F.sum("m"), 2.0) / F.sum(F.col("m") * F.col("m"))).alias("effective_dates"))


def hourly(df: DataFrame, keys: Sequence[str], ts: str, hours: int):
    """The last ``hours`` whole hours up to each row's, by value of the hour, so gaps need no filler rows."""
    return Window.partitionBy(*keys).orderBy(epoch_hour(F.col(ts))).rangeBetween(-(hours - 1), 0)


def full_window(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, function=F.sum) -> Column:
    """An aggregate over a window that must have a value in every hour, else null."""
    w = hourly(df, keys, ts, hours)
    return F.when(F.count(value).over(w) == hours, function(value).over(w))


def lagged(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int) -> Column:
    """The value exactly ``hours`` before, null where that hour has none."""
    w = Window.partitionBy(*keys).orderBy(epoch_hour(F.col(ts))).rangeBetween(-hours, -hours)
    return F.max(value).over(w)


def thermal_memory(df: DataFrame, keys: Sequence[str], ts: str, shortwave: str, longwave: str, air: str) -> DataFrame:
    """Energy, means, ranges and changes of the hours up to each row's hour, each with count, coverage and status.
    Negative shortwave and non-positive longwave are missing; a window needs all its hours, a change its two ends."""
    clean = df.withColumns({"__sw": F.when(F.col(shortwave) >= 0, F.col(shortwave)), "__lw": F.when(F.col(longwave) > 0, F.col(longwave)), "__air": F.col(air)})
    columns: dict[str, Column] = {}

    def window(prefix: str, value: str, hours: int) -> None:
        n = F.count(value).over(hourly(clean, keys, ts, hours))
        columns[f"{prefix}_valid_hours"] = n
        columns[f"{prefix}_coverage_fraction"] = n / hours
        columns[f"{prefix}_status"] = F.when(n == hours, "complete").otherwise("missing_history")

    for hours in (6, 12, 24):
        window(f"shortwave_{hours}h", "__sw", hours)
        columns[f"shortwave_energy_{hours}h_j_m2"] = full_window(clean, keys, ts, "__sw", hours) * 3600
    for hours in (6, 24):
        window(f"longwave_{hours}h", "__lw", hours)
        window(f"air_{hours}h", "__air", hours)
        columns[f"longwave_mean_{hours}h_w_m2"] = full_window(clean, keys, ts, "__lw", hours, F.avg)
        columns[f"air_mean_{hours}h_c"] = full_window(clean, keys, ts, "__air", hours, F.avg)
        columns[f"air_range_{hours}h_c"] = full_window(clean, keys, ts, "__air", hours, F.max) - full_window(clean, keys, ts, "__air", hours, F.min)
    for hours in (3, 6):
        columns[f"air_change_{hours}h_c"] = F.col("__air") - lagged(clean, keys, ts, "__air", hours)
    return clean.withColumns(columns).drop("__sw", "__lw", "__air")


def deaccumulate(df: DataFrame, keys: Sequence[str], step: str, mean: str) -> Column:
    """n * current - (n - 1) * previous of running means of one origin; the previous step must be n - 1."""
    w = Window.partitionBy(*keys).orderBy(step)
    current = F.col(step) * F.col(mean)
    return F.when(F.col(step) == 1, F.col(mean)).when(F.lag(step).over(w) == F.col(step) - 1, current - (F.col(step) - 1) * F.lag(mean).over(w))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in a total order (Spark cuts groups on the map side already)."""
    out = df.withColumn(rank or "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "__rank") <= k)
    return out if rank else out.drop("__rank")


def hash_order(key: str, seed: object) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, strata: Sequence[str], key: str, seed: object, k: int, rank: str | None = None) -> DataFrame:
    """k rows of each stratum by hash order: repeatable, and independent of partitions."""
    return top(df, strata, [hash_order(key, seed), F.col(key)], k, rank)


def round_robin_cap(df: DataFrame, strata: Sequence[str], key: str, seed: object, most: int) -> DataFrame:
    """At most ``most`` rows: the first of every stratum, then the second, and so on, each in hash order."""
    ranked = df.withColumn("__hash", hash_order(key, seed)).withColumn("__turn", F.row_number().over(Window.partitionBy(*strata).orderBy("__hash", key)))
    return ranked.orderBy("__turn", "__hash", key).limit(most).drop("__hash", "__turn")


def turns(df: DataFrame, queue: Sequence[str], order: Sequence[Column], name: str = "turn", span: Column | None = None) -> DataFrame:
    """Place of each row in its queue; ordering by (turn, queue) interleaves the queues.

    ``span``: a value that rises with the order, such as the day of a time. Rows are then numbered within their span and the
    spans' counts added up, so a queue with a third of all rows is spread over as many tasks as it has spans.
    """
    if span is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*queue).orderBy(*order)))
    cut = df.withColumn("__span", span)
    counts = cut.groupBy(*queue, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*queue).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = cut.withColumn(name, F.row_number().over(Window.partitionBy(*queue, "__span").orderBy(*order)))
    joined = _back(inside, counts.withColumn("__before", before).drop("__n"), [*queue, "__span"])
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__before", "__span")


def coverage_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Uncovered ranges between inclusive date intervals of a key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = df.withColumn("__reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return reach.filter(F.col(start) > F.date_add("__reach", 1)).select(*keys, F.date_add("__reach", 1).alias("gap_start"), F.date_sub(start, 1).alias("gap_end"))


def stencil(df: DataFrame, row: str, column: str, value: str, spacing: float) -> DataFrame:
    """Slope (Horn), aspect and relief from 3 by 3 neighbours; null where a neighbour is missing. Each cell is sent to its
    nine neighbours and added up by cell with signed weights: one shuffle of nine small rows a cell."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = df.select(F.col(row).alias("r0"), F.col(column).alias("c0"), F.col(value).alias("z"), F.explode(steps).alias("s")).select((F.col("r0") - F.col("s.i")).alias(row), (F.col("c0") - F.col("s.j")).alias(column), "z", F.col("s.i").alias("i"), F.col("s.j").alias("j"))
    weight = lambda main, side: F.col(main) * F.when(F.col(side) == 0, 2.0).otherwise(1.0) * F.col("z")
    sums = near.groupBy(row, column).agg(F.count("z").alias("n"), F.sum(weight("j", "i")).alias("x"), F.sum(weight("i", "j")).alias("y"), (F.max("z") - F.min("z")).alias("relief"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.lit(1))).alias("own"))
    dx, dy = F.col("x") / (8 * spacing), F.col("y") / (8 * spacing)
    full = F.col("n") == 9
    return sums.filter("own = 1").select(row, column, F.when(full, F.degrees(F.atan(F.hypot(dx, dy)))).alias("slope_deg"), F.when(full, F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0))).alias("aspect_deg"), F.when(full, F.col("relief")).alias("relief"))
