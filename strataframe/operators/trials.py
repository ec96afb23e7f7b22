"""Many fits over one table: memberships by exclusion, sums gathered in one pass, small systems solved together.

A fit leaves some granules out. Its membership is never written down: a table of (mode, key, granule) says what each fit
leaves out, and counts, weights and normal equations of what remains are those of all rows less those of what is left out.
So the work grows with the rows once and with the exclusions, not with rows times fits, and any number of fits is allowed.

Rows of which a feature, the target or the weight isn't a finite number are in no fit and not counted; where they are predicted,
they are predicted as null. A null granule is left out by no fit, a null group or month is held by none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..store import written

FIT = ["mode", "key"]


def exclusions(rows: DataFrame, catalogue: DataFrame, granule: str, group: str, month_start: str, month_end: str) -> DataFrame:
    """mode, key, granule of what each fit of the catalogue (mode, key) leaves out: granules that a held group or month
    touches, as a whole. Modes: pilot and reference hold a group, month holds a month; any other leaves nothing out."""
    cat = catalogue.select(FIT)
    groups, months = cat.filter("mode IN ('pilot', 'reference')"), cat.filter("mode = 'month'")
    seen = rows.select(group, granule).distinct().join(groups, F.col(group) == F.col("key"))
    ends = rows.select(granule, F.explode(F.array_distinct(F.array(month_start, month_end))).alias("__month")).distinct()
    return seen.select(*FIT, granule).union(ends.join(months, F.col("__month") == F.col("key")).select(*FIT, granule)).distinct()


def held_rows(rows: DataFrame, catalogue: DataFrame, group: str, month_mid: str, never: Sequence[str]) -> DataFrame:
    """Rows that each fit is tested on, with mode and key: those of its group, or of its month outside the groups in ``never``."""
    cat = catalogue.select(FIT)
    by_group = rows.join(cat.filter("mode IN ('pilot', 'reference')"), F.col(group) == F.col("key"))
    by_month = rows.filter(~F.col(group).isin(*never)) if never else rows
    return by_group.unionByName(by_month.join(cat.filter("mode = 'month'"), F.col(month_mid) == F.col("key")))


def train_rows(rows: DataFrame, excluded: DataFrame, mode: str, key: str, granule: str) -> DataFrame:
    """The fitting rows of one fit, taken at use."""
    return rows.join(excluded.filter((F.col("mode") == mode) & (F.col("key") == key)).select(granule), granule, "left_anti")


def train_counts(rows: DataFrame, catalogue: DataFrame, excluded: DataFrame, granule: str) -> DataFrame:
    """mode, key, n: how many of the rows each fit is fitted on."""
    by_granule = rows.groupBy(granule).agg(F.count(F.lit(1)).alias("__n"))
    gone = by_granule.join(excluded, granule).groupBy(FIT).agg(F.sum("__n").alias("__gone"))
    total = by_granule.agg(F.sum("__n")).first()[0] or 0
    return catalogue.select(FIT).distinct().join(gone, FIT, "left").select(*FIT, (F.lit(total) - F.coalesce("__gone", F.lit(0))).alias("n"))


def sum_names(p: int) -> list[str]:
    """Columns of a system of p features: the upper triangle of X'WX, then X'Wy."""
    return [f"m{i}" for i in range(p * (p + 3) // 2)]


def products(features: Sequence[Column], target: Column) -> list[Column]:
    p = len(features)
    return [features[i] * features[j] for i in range(p) for j in range(i, p)] + [f * target for f in features]


def complete(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """Rows of which all values are finite numbers."""
    for v in values:
        df = df.filter(F.coalesce(finite(v.cast("double")), F.lit(False)))
    return df


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[Column], target: Column, weight: Column) -> DataFrame:
    """keys, n and the sums of every key's system, in one pass."""
    sums = [F.sum(weight * x).alias(c) for x, c in zip(products(features, target), sum_names(len(features)), strict=True)]
    return complete(df, [*features, target, weight]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def solved(systems: DataFrame, p: int, alpha: float) -> DataFrame:
    """The columns of ``systems`` less its sums, and ``coefficients`` of (X'WX + alpha) c = X'Wy: null where a sum is null or
    the system has no solution. Rows of a batch are solved together."""
    names = sum_names(p)
    rest = [c for c in systems.columns if c not in names]
    rows, columns = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]).reshape(len(names), -1).T
            a = np.zeros((len(m), p, p))
            a[:, rows, columns] = a[:, columns, rows] = m[:, : len(rows)]
            a += alpha * np.eye(p)
            good = np.isfinite(m).all(axis=1)
            good[good] = np.linalg.matrix_rank(a[good]) == p if good.any() else good[good]
            found = np.zeros((len(m), p))
            found[good] = np.linalg.solve(a[good], m[good][:, len(rows) :, None])[:, :, 0] if good.any() else 0
            answers = pa.array([list(map(float, c)) if ok else None for c, ok in zip(found, good, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), answers], names=[*rest, "coefficients"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in systems.schema if f.name in rest]
    return systems.select(*rest, *names).mapInArrow(run, ", ".join([*kinds, "coefficients array<double>"]))


def predict(features: Sequence[Column], coefficients: str = "coefficients") -> Column:
    out = F.lit(0.0)
    for k, f in enumerate(features):
        out = out + f * F.col(coefficients)[k]
    return out


def out_of_fold(df: DataFrame, fold: str, features: Sequence[Column], target: Column, weight: Column, alpha: float) -> DataFrame:
    """Each row predicted (oof_prediction) by the ridge fit of all folds but its own: the sums of each fold are gathered once
    and taken off their total. A row without a fold is predicted by the fit of all others."""
    p = len(features)
    names = sum_names(p)
    by_fold = written(moments(df, [fold], features, target, weight), "fold-sums")
    every = by_fold.agg(*(F.sum(c).alias(c) for c in names)).first()
    rest = by_fold.select(fold, *((F.lit(every[c]).cast("double") - F.col(c)).alias(c) for c in names))
    fits = F.broadcast(solved(rest, p, alpha).withColumnRenamed(fold, "__fold"))  # a row a fold
    return df.join(fits, F.col(fold).eqNullSafe(F.col("__fold")), "left").withColumn("oof_prediction", predict(features)).drop("__fold", "coefficients")


def experts(df: DataFrame, group: str, eligible: Column, features: Sequence[Column], target: Column, weight: Column, alpha: float, extra: Sequence[Column] = (), broadcast_rows: int = 100_000) -> DataFrame:
    """Rows with ``routed_prediction`` and ``route``: the ridge fit of a row's own group where ``eligible`` holds of the group
    (an aggregate of its rows: n, or one of ``extra``), else of all rows. Any number of groups, one pass over the rows."""
    p = len(features)
    names = sum_names(p)
    sums = [F.sum(weight * x).alias(c) for x, c in zip(products(features, target), names, strict=True)]
    by_group = written(complete(df, [*features, target, weight]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *extra, *sums), "group-sums")
    shared = by_group.agg(*(F.sum(c).alias(c) for c in names))
    shared = solved(shared, p, alpha).first()["coefficients"] or [None] * p
    own = written(solved(by_group.filter(eligible).select(group, *names), p, alpha).filter("coefficients IS NOT NULL").withColumnRenamed(group, "__group"), "experts")
    own = F.broadcast(own) if own.count() <= broadcast_rows else own
    routed = df.join(own, F.col(group) == F.col("__group"), "left").withColumn("__shared", F.array(*(F.lit(c).cast("double") for c in shared)))
    best = F.when(F.col("coefficients").isNotNull(), predict(features)).otherwise(predict(features, "__shared"))
    route = F.when(F.col("coefficients").isNotNull(), F.col(group).cast("string")).otherwise("shared")
    return routed.withColumns({"routed_prediction": best, "route": route}).drop("__group", "coefficients", "__shared")


def trial(
    rows: DataFrame, catalogue: DataFrame, excluded: DataFrame, arms: dict[str, Column], *, ident: str, region: str, phase: str, date: str, acquisition: str, granule: str,
    area: Column, features: Sequence[Column], target: Column, alpha: float, least: tuple[int, int, int] = (80, 2, 2),
) -> DataFrame:
    """mode, key, arm, rows, regions, dates, digest, status, origin, coefficients of each fit in each arm.

    ``arms``: conditions over the keys of a row (region, phase, date, acquisition, granule). Within an arm and a fit every
    (region, phase) weighs the same, and in it every date, in it every acquisition, in it the area; weights have a mean of 1.
    Fits with fewer than ``least`` rows, regions or dates are ``insufficient_fitting_support``; of fits with the same rows,
    known by an order-free digest of them, the first by arm, mode and key is ``fitted`` and the others are
    ``reused_exact_recipe``, with its name as origin. A row without a region, phase, date or acquisition has no weight and is in no
    fit. Rows are shuffled once to their granule, which knows the fits that leave it out, and once to their group and date. There
    each fit's losses are added up and taken off what all rows give, first of the acquisitions that lose some of their granules,
    then of dates, then of groups: no fit's remaining rows are ever made, and what is written has a row a fit and group.
    """
    p, group = len(features), [region, phase]
    names, keys = sum_names(p), [*group, date, acquisition, granule]
    every_row = F.lit(-1)  # in the place of a fit: what all rows give
    ids = written(catalogue.select(FIT).distinct().withColumn("__fit", F.monotonically_increasing_id()), "fit-ids")
    leavers = excluded.dropna(subset=[granule]).join(ids, FIT).groupBy(granule).agg(F.collect_list("__fit").alias("__fits"))  # a number a fit
    values = {**{f"__x{i}": f for i, f in enumerate(features)}, "__y": target, "__area": area, "__hash": F.xxhash64(F.col(ident))}
    used = complete(rows, [*features, target, area]).dropna(subset=keys[:-1]).select(*keys, *(v.alias(k) for k, v in values.items()))
    dealt = used.join(leavers, granule, "left").repartition(*group, date)  # all that follows, down to what is written, stays there
    area_of = F.col("__area")
    sums = [F.sum(area_of * x).alias(c) for x, c in zip(products([F.col(f"__x{i}") for i in range(p)], F.col("__y")), names, strict=True)]
    halves = [F.sum(F.shiftright("__hash", 32)).alias("high"), F.sum(F.col("__hash").bitwiseAND(F.lit((1 << 32) - 1))).alias("low")]
    leaf = dealt.groupBy(*keys, "__fits").agg(F.count(F.lit(1)).alias("n"), F.sum(area_of).alias("area"), *halves, *sums)
    leaf = leaf.withColumn("__whole", F.count(F.lit(1)).over(Window.partitionBy(*group, date, acquisition)) == 1)
    arm = F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in arms.items())))).alias("arm")
    fit = F.explode(F.concat(F.array(every_row.cast("long")), F.coalesce("__fits", F.array().cast("array<long>")))).alias("__fit")

    # an acquisition of one granule is kept or lost as a whole, so those of a date are added up; the others are kept apart
    split = F.when(~F.col("__whole"), F.col(acquisition)).alias("__split")
    inside = [F.when(F.col("__whole"), F.col(c) / F.col("area")).otherwise(F.col(c)).alias(c) for c in names]
    counts = ["n", "high", "low"]
    leaf = leaf.select(*group, date, split, *counts, "area", *inside, "__fits", arm).select("*", fit)
    is_all = F.col("__fit") == every_row

    def of_all(column: str, cells: Window) -> Column:
        return F.max(F.when(is_all, F.col(column))).over(cells)

    def changed(df: DataFrame, keep: Sequence[str], cells: Window, parts: str, size: str, one: Column | None = None) -> DataFrame:
        """Of the sums and ``size`` of a cell's rows and of what each fit takes off them: the ratio that all rows give, and how that
        of each fit differs. ``parts``: how many children the cell has, or a fit takes off; ``there``: 1 for all rows, -1 where a
        fit takes off all of them. Where ``one`` holds a row is a sum over whole cells, and only its sign changes."""
        df = df.select("*", *(of_all(c, cells).alias(f"__all_{c}") for c in dict.fromkeys([*names, parts, size])))
        lost = F.col(parts) == F.col(f"__all_{parts}")
        ratio = lambda c: F.col(f"__all_{c}") / F.col(f"__all_{size}")
        left = lambda c: (F.col(f"__all_{c}") - F.col(c)) / (F.col(f"__all_{size}") - F.col(size))
        value = lambda c: F.when(is_all, ratio(c)).when(lost, -ratio(c)).otherwise(left(c) - ratio(c))
        there = F.when(is_all, 1).when(lost, -1).otherwise(0).cast("long")
        plain = lambda column: F.when(is_all, column).otherwise(-column)
        pick = lambda usual, single: usual if one is None else F.when(one, single).otherwise(usual)
        return df.select(*keep, *counts, *(pick(value(c), plain(F.col(c))).alias(c) for c in names), pick(there, plain(F.col(parts))).alias("there"))

    def added(df: DataFrame, by: Sequence[str]) -> DataFrame:
        """The cells of one level as children of the next: what fits change, as what they take off."""
        return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts), *(F.when(is_all, F.sum(c)).otherwise(-F.sum(c)).alias(c) for c in names), F.when(is_all, F.sum("there")).otherwise(-F.sum("there")).alias("there"))

    by = ["arm", "__fit", *group, date]
    cells = leaf.groupBy(*by, "__split").agg(*(F.sum(c).alias(c) for c in [*counts, "area", *names]), F.count(F.lit(1)).alias("parts"))
    cells = changed(cells, by, Window.partitionBy("arm", *group, date, "__split"), "parts", "area", F.col("__split").isNull())
    dates = changed(added(cells, by), by, Window.partitionBy("arm", *group, date), "there", "there")
    # one table for both: sums by fit and group, and the dates that all rows have and that a group loses as a whole
    gone = F.when(F.col("there") != 0, F.col(date)).alias("__date")
    found = dates.select(*by[:-1], gone, *counts, *names, "there")
    digest = F.sum(F.col("high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low").cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")
    parts = written(found.groupBy(*by[:-1], "__date").agg(F.sum("n").alias("n"), digest, *(F.sum(c).alias(c) for c in [*names, "there"])), "group-sums")
    counts = ["n", "digest"]
    all_of, out = parts.filter(is_all), parts.filter(~is_all)
    groups = changed(added(parts, by[:-1]), by[:-1], Window.partitionBy("arm", *group), "there", "there")
    change = groups.filter(~is_all).groupBy("__fit", "arm").agg(*(F.sum(c).alias(f"d_{c}") for c in [*counts, *names]), F.sum("there").alias("d_groups"))
    total = groups.filter(is_all).groupBy("arm").agg(*(F.sum(c).alias(c) for c in names), F.sum("there").alias("groups"))
    total = total.join(all_of.groupBy("arm").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"), F.count_distinct(region).alias("regions"), F.count_distinct("__date").alias("dates")), "arm")

    def lost(column: str, part: Column, name: str) -> DataFrame:
        """How many values of the column no row of the fit has any more."""
        had = all_of.groupBy("arm", column).agg(F.sum(part).alias("had"))
        left = out.dropna(subset=[column]).groupBy("__fit", "arm", column).agg(F.sum(part).alias("left"))
        return left.join(had, ["arm", column]).filter("left = had").groupBy("__fit", "arm").agg(F.count(F.lit(1)).alias(f"d_{name}"))

    every = ids.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    every = every.join(total, "arm", "left")
    for part in (change, lost(region, F.col("n"), region), lost("__date", F.lit(1), date)):  # a date is lost where all its groups lose it
        every = every.join(part, ["__fit", "arm"], "left")
    none = F.lit(0)
    scale = F.col("n") - F.coalesce("d_n", none)
    groups = F.col("groups") + F.coalesce("d_groups", none)
    counts = [F.coalesce(scale, none).alias("rows"), F.coalesce(F.col("regions") - F.coalesce(f"d_{region}", none), none).alias("regions"), F.coalesce(F.col("dates") - F.coalesce(f"d_{date}", none), none).alias("dates")]
    systems = [(F.try_divide((F.col(c) + F.coalesce(f"d_{c}", F.lit(0.0))) * scale, groups)).alias(c) for c in names]
    every = written(every.select(*FIT, "arm", *counts, (F.col("digest") - F.coalesce("d_digest", none)).cast("decimal(38,0)").alias("digest"), *systems), "systems")
    enough = (F.col("rows") >= least[0]) & (F.col("regions") >= least[1]) & (F.col("dates") >= least[2])
    same = Window.partitionBy("digest", "rows").orderBy("arm", *FIT)
    ranked = every.filter(enough).withColumns({"__nth": F.row_number().over(same), "origin": F.first(F.concat_ws("/", *FIT, "arm")).over(same)})
    fitted = solved(ranked.filter("__nth = 1").select(F.col("digest").alias("__digest"), F.col("rows").alias("__rows"), *names), p, alpha)
    joined = ranked.join(fitted, (F.col("digest") == F.col("__digest")) & (F.col("rows") == F.col("__rows")))
    status = F.when(F.col("__nth") == 1, "fitted").otherwise("reused_exact_recipe")
    columns = [*FIT, "arm", "rows", "regions", "dates", "digest"]
    poor = every.filter(~enough).select(*columns, F.lit("insufficient_fitting_support").alias("status"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("array<double>").alias("coefficients"))
    return joined.select(*columns, status.alias("status"), "origin", "coefficients").union(poor)


def scores(held: DataFrame, fits: DataFrame, features: Sequence[Column], target: Column, broadcast_rows: int = 100_000) -> DataFrame:
    """mode, key, arm, held_rows, mae of the rows that each fit was not fitted on (mode, key, ...), those that it can predict."""
    usable = written(fits.filter("coefficients IS NOT NULL").select(*FIT, "arm", "coefficients"), "coefficients")
    joined = complete(held, [*features, target]).join(F.broadcast(usable) if usable.count() <= broadcast_rows else usable, FIT)
    return joined.groupBy(*FIT, "arm").agg(F.count(F.lit(1)).alias("held_rows"), F.avg(F.abs(predict(features) - target)).alias("mae"))
