"""Operators of a release: admission gates of new cohorts, audits of what was published, lookups by place and time, overlays
on polygons, partitions and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..store import written
from .contracts import ContractError, require, require_unique
from .joins import asof_backward, residual_corrected
from .windows import top

# gates


def support_code(rules: Sequence[Column]) -> Column:
    """The number, from 1, of the first rule that excludes a row; 0 if none does."""
    return E.ladder([(F.coalesce(c, F.lit(False)), i) for i, c in enumerate(rules, 1)], 0)


def clear_of_gaps(cells: DataFrame, row: str, col: str, good: Column, size: float, buffer: float, keys: Sequence[str] = (), absent_is_good: bool = False) -> DataFrame:
    """Adds ``clear``: the cell and all cells whose centre is within ``buffer`` are good; a cell that isn't there is not,
    unless ``absent_is_good``.

    Good cells (or bad ones, where absent ones are good) are spread over the offsets within the buffer and counted where they
    arrive, so it is one equality join.
    """
    reach = int(buffer // size)
    around = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if np.hypot(i, j) * size <= buffer]
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around)))
    ok = F.coalesce(good, F.lit(False))
    sent = cells.filter(~ok if absent_is_good else ok).select(*keys, row, col, offsets.alias("__o"))
    count = sent.groupBy(*keys, (F.col(row) + F.col("__o.i")).alias(row), (F.col(col) + F.col("__o.j")).alias(col)).agg(F.count(F.lit(1)).alias("__n"))
    clear = F.col("__n").isNull() if absent_is_good else F.coalesce(F.col("__n") == len(around), F.lit(False))
    return cells.join(count, [*keys, row, col], "left").withColumn("clear", clear).drop("__n")


def swath_gates(qc: Column, lst: Column, error: Column, view: Column, ocean: Column) -> dict[str, Column]:
    """The eight gates of a swath cell by name, from its quality word and stored numbers (scales: 0.02 K, 0.04 K)."""
    q = E.swath_quality(qc)
    kelvin = lst * 0.02
    return {
        "mandatory_ok": q["mandatory"] == 0, "data_ok": q["data"] == 0, "cloud_clear": q["cloud"] == 0, "error_class_ok": q["lst_error"] >= 2,
        "error_ok": (error > 0) & (error * 0.04 <= 1.5), "view_ok": view <= 60, "land": ocean == 0, "lst_range": (lst != 0) & (kelvin >= 150) & (kelvin <= 400),
    }


def revalidated(new: DataFrame, reference: DataFrame, rules: Sequence[tuple[Column, str]], id_col: str, cell: Sequence[str]) -> DataFrame:
    """Every new row with the first reason why it can't enter: the rules' (null fails), then an id of an earlier cohort, a
    physical cell that the new rows hold twice, and a cell of an earlier cohort."""
    ids = reference.select(id_col).distinct().withColumn("__known_id", F.lit(True))
    cells = reference.select(*cell).distinct().withColumn("__known_cell", F.lit(True))
    twice = new.groupBy(*cell).agg((F.count(F.lit(1)) > 1).alias("__twice"))
    flagged = new.join(ids, id_col, "left").join(cells, list(cell), "left").join(twice, list(cell), "left")
    last = [(~F.coalesce(F.col(c), F.lit(False)), r) for c, r in (("__known_id", "known_identity"), ("__twice", "repeated_cell"), ("__known_cell", "known_cell"))]
    return flagged.withColumn("reason", E.first_reason([(~E.passes(c), r) for c, r in [*rules, *last]])).drop("__known_id", "__known_cell", "__twice")


def exact_hour_gate(rows: DataFrame, plan: DataFrame, batch: str, ts: str, lat: str, lon: str) -> DataFrame:
    """For each batch: rows, those off the planned hour or with an unusable coordinate, and whether the batch is accepted.
    ``plan``: batch, valid_ts, enabled; a batch without a plan is not enabled, and no other time stands in."""
    ok = lambda c, most: E.finite(F.col(c)) & F.col(c).between(-most, most)
    counts = rows.join(plan, batch, "left").groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~E.passes(F.col(ts) == F.col("valid_ts"))).alias("off_hour"), F.count_if(~E.passes(ok(lat, 90))).alias("bad_latitude"), F.count_if(~E.passes(ok(lon, 180))).alias("bad_longitude"),
        F.coalesce(F.bool_and("enabled"), F.lit(False)).alias("enabled"),
    )
    return counts.withColumn("accepted", F.col("enabled") & (F.col("off_hour") + F.col("bad_latitude") + F.col("bad_longitude") == 0))


def requested_time(mode: Column, requested: Column, source: Column, years: Sequence[int], most_days: float = 90, scenario: tuple[int, int] = (1900, 2100)) -> tuple[Column, Column]:
    """Why a requested time can't be served from a source (null: it can), and the source's age in days."""
    age = (E.epoch(requested) - E.epoch(source)) / 86400
    free = mode == "scenario"
    reason = E.first_reason([
        (~F.coalesce(mode.isin("observed", "experimental", "scenario"), F.lit(False)), "unknown_mode"), (requested.isNull() | source.isNull(), "missing_time"),
        (free & ~F.year(requested).between(*scenario), "outside_scenario_years"), (~free & ~(F.year(requested).isin(*years) & F.year(source).isin(*years)), "outside_pilot_years"),
        (~free & (age < 0), "future_source"), ((mode == "observed") & (age != 0), "not_the_source_time"), (~free & (age > most_days), "stale_source"),
    ])
    return reason, age


# columns and frames


def replace_columns(df: DataFrame, old: Sequence[str], values: DataFrame, key: str, new: Sequence[str]) -> DataFrame:
    """The last columns ``old`` give way to ``new`` of ``values`` (one row a key, all finite); all others stay in order."""
    if df.columns[-len(old) :] != list(old):
        raise ContractError(f"the last columns must be {list(old)}")
    right = require(require_unique(values, [key]), {f"{c} finite": E.finite(F.col(c)) for c in new})
    joined = df.drop(*old).join(right.select(key, *new), key, "left")
    require(joined, {f"{c} for every row": F.col(c).isNotNull() for c in new})
    return joined.select(*df.columns[: -len(old)], *new)


def frozen_apply(df: DataFrame, batch: str, features: Sequence[str], prediction: Column) -> DataFrame:
    """A frozen model's prediction for each row. A batch with a feature or a result that is not finite is refused as a
    whole: its rows stay, without a prediction."""
    scored = df.withColumn("__p", prediction)
    bad = scored.groupBy(batch).agg(F.count_if(~E.passes(E.all_of([E.finite(F.col(c)) for c in (*features, "__p")]))).alias("__bad"))
    joined = scored.join(bad, batch, "left")
    good = F.col("__bad") == 0
    return joined.withColumns({"prediction": F.when(good, F.col("__p")), "status": F.when(good, "predicted").otherwise("refused_batch")}).drop("__p", "__bad")


# lookups


def attach_stations(rows: DataFrame, stations: DataFrame, reports: DataFrame, background: DataFrame, *, id_col: str, area: str, ts: str, distance: Column, most_km: float = 100, most_minutes: float = 90, most_residual: float = 20) -> DataFrame:
    """The nearest usable station as of each row's time: air = background(row) + (report - background(station, its time)).

    rows: area, ts, background; stations: area, station, rank (the earlier of equals wins); reports: station, at, reported,
    report_id; background: station, hour, station_background. Without a usable station the row keeps its background, and
    ``source`` says so. Candidates are joined by area, reports as of the time, one row a candidate; nothing else meets.
    """
    offered = rows.join(stations, area).withColumn("station_km", distance)
    matched = asof_backward(offered, reports, ["station"], ts, ["reported"], most_minutes * 60, "report_id", right_ts="at")
    hour = background.select(F.col("station").alias("__s"), F.col("hour").alias("__h"), "station_background")
    there = matched.join(hour, (F.col("station") == F.col("__s")) & (E.floor_hour(F.col("matched_ts")) == F.col("__h")), "left").withColumn("age_minutes", F.col("age_s") / 60)
    air = residual_corrected(F.col("background"), F.col("reported"), F.col("station_background"), F.col("station_km"), F.col("age_minutes"), most_residual, most_km, most_minutes)
    best = top(there.withColumn("air", air).filter("air IS NOT NULL"), [id_col], [F.col("station_km"), F.col("rank")]).select(id_col, "station", "station_km", "age_minutes", "air")
    joined = rows.join(best, id_col, "left")
    return joined.withColumns({"source": F.when(F.col("air").isNull(), "background_only").otherwise("station_residual_plus_background"), "air": F.coalesce("air", "background")})


def labels_by_position(features: DataFrame, raster: DataFrame, position: str, value: str, tags: dict[str, Column]) -> DataFrame:
    """Feature rows with the observed value at their place in the raster; only finite values stay, tagged."""
    labels = raster.filter(E.finite(F.col(value))).select(position, F.col(value).alias("label"))
    return features.join(require_unique(labels, [position]), position).withColumns(tags)


def class_lookup(points: DataFrame, classes: DataFrame, row: Column, col: Column, code: str) -> DataFrame:
    """Class of the grid cell of each point; outside the grid or without a code it is unknown, and the status says so."""
    cells = classes.select(F.col("row").alias("__r"), F.col("col").alias("__c"), code)
    joined = points.withColumns({"__row": row, "__col": col}).join(cells, (F.col("__row") == F.col("__r")) & (F.col("__col") == F.col("__c")), "left")
    label = E.climate_label(F.col(code))
    return joined.withColumns({"class": label, "status": F.when(label == "unknown", "unknown_or_nodata").otherwise("classified")}).drop("__row", "__col", "__r", "__c", code)


def footprint_share(scenes: DataFrame, id_col: str, xs: str, ys: str, extent: Sequence[Column], cells: int = 80) -> DataFrame:
    """Share of ``cells`` by ``cells`` sample points of an extent (x0, y0, x1, y1) that lie inside a scene's convex ring (the border
    counts; a ring or extent with an unknown number holds none). Scenes are dealt out first, as a small table of them is one
    task's input, and a scene stays one row: its points are tested together."""
    steps = np.arange(cells) + 0.5

    def shares(ring: tuple[np.ndarray, np.ndarray], box: np.ndarray) -> np.ndarray:
        px, py = (box[:, [k]] + steps * (box[:, [k + 2]] - box[:, [k]]) / cells for k in (0, 1))
        left = right = np.True_
        for i in range(ring[0].shape[1]):
            j = (i + 1) % ring[0].shape[1]
            x, y, nx, ny = (v[:, [k]] for k in (i, j) for v in ring)
            cross = ((nx - x) * (py - y))[:, None, :] - ((ny - y) * (px - x))[:, :, None]
            left, right = left & (cross >= 0), right & (cross <= 0)
        return (left | right).mean(axis=(1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [[np.array(r if r is not None else [], dtype=float) for r in batch.column(c).to_pylist()] for c in (1, 2)]
            boxes = np.array([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(3, 7)]).T
            sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(*rings, strict=True)], dtype=int)
            out = np.zeros(len(sizes))
            for n in set(sizes.tolist()) - {0}:
                of = np.flatnonzero(sizes == n)
                for part in np.array_split(of, -(-len(of) // 64)):
                    out[part] = shares(tuple(np.array([r[k] for k in part]) for r in rings), boxes[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "share"])

    tasks = 4 * scenes.sparkSession.sparkContext.defaultParallelism
    rows = scenes.select(id_col, F.col(xs).cast("array<double>"), F.col(ys).cast("array<double>"), *(c.cast("double").alias(f"__{k}") for k, c in enumerate(extent))).repartition(tasks, id_col)
    found = rows.mapInArrow(run, f"`{id_col}` {scenes.schema[id_col].dataType.simpleString()}, share double")
    return found.groupBy(id_col).agg(F.avg("share").alias("share"))


def midpoint_audit(rows: DataFrame, other: DataFrame, key: str, start: str, stop: str, area: str) -> DataFrame:
    """Each row's match in ``other`` (key, at, its_area): missing, area_differs, midpoint_differs or matched."""
    joined = rows.join(require_unique(other, [key]), key, "left")
    middle = (F.unix_micros(start) + F.unix_micros(stop)) / 2
    return joined.withColumn("status", E.ladder([(F.col("at").isNull(), "missing"), (F.col("its_area") != F.col(area), "area_differs"), (F.unix_micros("at") != middle, "midpoint_differs")], "matched"))


# overlays


def clipped_areas(x: np.ndarray, y: np.ndarray, half: float, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Area of square (x, y centre) and convex polygon (a row of vertices) in common, for all pairs at once: each side of the
    square cuts all polygons, whose vertices stay packed to the left."""
    count = np.full(len(x), px.shape[1])
    for axis, sign in ((0, 1), (0, -1), (1, 1), (1, -1)):
        edge = (x if axis == 0 else y) - sign * half
        inside = sign * ((px if axis == 0 else py) - edge[:, None])  # not negative: kept
        m = px.shape[1]
        place = np.arange(m)
        used = place < count[:, None]
        after = np.where(place + 1 < count[:, None], place + 1, 0)
        take = lambda v, after=after: np.take_along_axis(v, after, 1)
        here, there = inside >= 0, take(inside) >= 0
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(here != there, inside / (inside - take(inside)), 0.0)
        cut = [px + part * (take(px) - px), py + part * (take(py) - py)]
        keep = np.stack([here & used, (here != there) & used], axis=2).reshape(len(x), -1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : m + 1]
        px, py = (np.take_along_axis(np.stack([v, c], axis=2).reshape(len(x), -1), order, 1) for v, c in zip((px, py), cut, strict=True))
        count = keep.sum(axis=1)
    used = np.arange(px.shape[1]) < count[:, None]
    after = np.where(np.arange(px.shape[1]) + 1 < count[:, None], np.arange(px.shape[1]) + 1, 0)
    cross = px * np.take_along_axis(py, after, 1) - py * np.take_along_axis(px, after, 1)
    return np.abs(np.where(used, cross, 0.0).sum(axis=1)) / 2


def polygon_overlay(fine: DataFrame, polygons: DataFrame, fine_size: float, id_col: str, value: str, valid: Column, shifts: Sequence[tuple[float, float]] = ((0.0, 0.0),), square: float | None = None) -> DataFrame:
    """Mean of square fine cells (x, y centres) over convex polygons (xs, ys, all with as many vertices), weighted by the area
    in common, with the valid share of the polygon's area, for each shift. Polygons go to the grid squares their boxes touch;
    areas of the pairs that meet there are cut in Arrow batches."""
    square = square or 10 * fine_size
    half = fine_size / 2
    at = lambda v: F.floor(v / square).cast("long")
    moves = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy")) for a, b in shifts))).alias("__m")
    moved = polygons.select(id_col, "xs", "ys", moves).select(id_col, F.col("__m.dx").alias("dx"), F.col("__m.dy").alias("dy"), F.transform("xs", lambda v: v + F.col("__m.dx")).alias("xs"), F.transform("ys", lambda v: v + F.col("__m.dy")).alias("ys")).withColumn("area", F.abs(E.shoelace(F.col("xs"), F.col("ys"))))
    span = lambda c: F.explode(F.sequence(at(F.array_min(c) - half), at(F.array_max(c) + half)))
    spread = moved.withColumn("gx", span("xs")).withColumn("gy", span("ys"))
    cells = fine.select("x", "y", F.col(value).cast("double").alias("v"), F.coalesce(valid, F.lit(False)).alias("ok"), at(F.col("x")).alias("gx"), at(F.col("y")).alias("gy"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ring = [np.stack(table[c].to_numpy()).astype(float) for c in ("xs", "ys")]
            w = clipped_areas(table["x"].to_numpy().astype(float), table["y"].to_numpy().astype(float), half, *ring)
            yield table.select([id_col, "dx", "dy", "area", "v", "ok"]).append_column("w", pa.array(w)).combine_chunks().to_batches()[0]

    near = spread.join(cells, ["gx", "gy"]).filter((F.col("x") + half > F.array_min("xs")) & (F.col("x") - half < F.array_max("xs")) & (F.col("y") + half > F.array_min("ys")) & (F.col("y") - half < F.array_max("ys")))
    kind = polygons.schema[id_col].dataType.simpleString()
    hit = near.select(id_col, "dx", "dy", "area", "v", "ok", "x", "y", "xs", "ys").mapInArrow(weigh, f"{id_col} {kind}, dx double, dy double, area double, v double, ok boolean, w double").filter("w > 1e-9")
    good = F.when(F.col("ok"), F.col("w"))
    return hit.groupBy(id_col, "dx", "dy").agg((F.sum(good * F.col("v")) / F.sum(good)).alias("mean"), (F.coalesce(F.sum(good), F.lit(0.0)) / F.max("area")).alias("valid_fraction"), F.count(good).alias("cells"))


# audits and intervals


def replay_audit(ledger: DataFrame, saved: DataFrame, keys: Sequence[str], date: Sequence[str], observed: str, base: str, corrected: str, supported: str, most: float, tolerance: float = 1e-9) -> DataFrame:
    """Whether a ledger of predictions reproduces what was published (keys, n, date_count, mae): counts first, then the mean
    error, then the correction's bound, then rows without support that must keep the base. Groups published without
    observations and observations never published are told apart."""
    change = F.abs(F.col(corrected) - F.col(base))
    now = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(*date).alias("__dates"), F.avg(F.abs(F.col(corrected) - F.col(observed))).alias("__mae"), F.max(change).alias("__change"), F.count_if(~F.col(supported) & (change > tolerance)).alias("__moved"))
    joined = saved.join(now, list(keys), "full_outer")
    status = E.ladder([
        (F.col("n").isNull(), "not_published"), (F.col("__n").isNull() & (F.col("n") > 0), "no_such_observations"), (F.col("__n").isNull(), "unsupported_no_observations"),
        ((F.col("n") != F.col("__n")) | (F.col("date_count") != F.col("__dates")), "counts_differ"), (~E.passes(F.abs(F.col("mae") - F.col("__mae")) <= tolerance), "mae_differs"),
        (F.col("__change") > most + tolerance, "correction_exceeds_limit"), (F.col("__moved") > 0, "unsupported_rows_changed"),
    ], "reproduced")
    return joined.select(*keys, status.alias("status"))


def date_contributions(df: DataFrame, prediction: Column, observed: Column, weight: str, acquisition: Sequence[str], thresholds: Sequence[float]) -> tuple[DataFrame, list[Column]]:
    """Rows with the nine paired metrics' numerators as columns m0 to m8: weighted absolute error, error, three tails, the
    contrast after each acquisition's weighted mean error, then the plain absolute error and two plain tails."""
    e = prediction - observed
    mean = df.groupBy(*acquisition).agg((F.sum(e * F.col(weight)) / F.sum(weight)).alias("__mean"))
    w, size = F.col(weight), F.abs(e)
    tail = lambda t: F.when(size > t, 1.0).otherwise(0.0)
    parts = [size * w, e * w, *(tail(t) * w for t in thresholds), F.abs(e - F.col("__mean")) * w, size, *(tail(t) for t in thresholds[1:])]
    return df.join(mean, list(acquisition)), [p.alias(f"m{i}") for i, p in enumerate(parts)]


def date_bootstrap(daily: DataFrame, date: str, metrics: dict[str, tuple[str, str]], denominators: Sequence[str], draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Intervals of candidate minus reference for each metric: dates are drawn with replacement, as many as there are, the
    same for all metrics. ``metrics``: name to (numerator of the difference, its denominator) in ``daily`` (a row a date).

    The slots of a draw pick dates by a hash of seed, draw and slot, so reruns agree; rows are draws times dates.
    """
    spark: SparkSession = daily.sparkSession
    numbered = written(daily.withColumn("__at", F.row_number().over(Window.orderBy(date)) - 1), "bootstrap-dates")  # a row a date of the calendar
    n = numbered.count()
    if not n:
        return spark.createDataFrame([], "metric string, low double, high double")
    slots = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("slot"))
    picked = slots.withColumn("__at", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int"))
    times = picked.groupBy("draw", "__at").agg(F.count(F.lit(1)).alias("__k"))
    columns = dict.fromkeys([*(c for pair in metrics.values() for c in pair), *denominators])
    sums = times.join(F.broadcast(numbered) if n <= 100_000 else numbered, "__at").groupBy("draw").agg(*(F.sum(F.col("__k") * F.col(c)).alias(c) for c in columns))
    stacked = sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(a) / F.col(b)).alias("v")) for m, (a, b) in metrics.items()))).alias("r")).select("r.*")
    return stacked.groupBy("metric").agg(F.percentile("v", low).alias("low"), F.percentile("v", high).alias("high"))


# partitions and registries


def block_partitions(df: DataFrame, ts: str, x: str, y: str, block: tuple[float, float, float, float], buffer: float, last_train: int) -> DataFrame:
    """train, development, calibration, test, spatial_test: whole years and half years in time; the block (left, bottom, right,
    top) with its buffer never trains, and is a test of its own up to the year after training."""
    left, bottom, right, top_ = block
    reserved = F.coalesce(F.col(x).between(left - buffer, right + buffer) & F.col(y).between(bottom - buffer, top_ + buffer), F.lit(False))
    year, month = F.year(ts), F.month(ts)
    return df.withColumns({
        "train": (year <= last_train) & ~reserved, "development": (year == last_train + 1) & (month < 7) & ~reserved, "calibration": (year == last_train + 1) & (month >= 7) & ~reserved,
        "test": year == last_train + 2, "spatial_test": reserved & (year <= last_train + 1),
    })


def combine_registries(original: DataFrame, new: DataFrame, region: str, group: Sequence[str], role: str, mapping: dict[str, str], reference: Sequence[str]) -> DataFrame:
    """Both registries of required groups as one, with family, role and id of each group. Regions of one must not be in the
    other, groups must not repeat, and roles must be known; else it is an error."""
    require(new, {"known roles": F.col(role).isin(*mapping)})
    if not original.select(region).distinct().join(new.select(region).distinct(), region, "left_semi").isEmpty():
        raise ContractError("registries share regions")
    roles = F.create_map(*(F.lit(v) for pair in mapping.items() for v in pair))
    old = original.select(*group, F.lit("original").alias("family"), F.when(F.col(region).isin(*reference), "original_reference").otherwise("original_development").alias("geography_role"))
    both = old.unionByName(new.select(*group, F.lit("catalogue").alias("family"), roles[F.col(role)].alias("geography_role")))
    return require_unique(both, group).withColumn("group_id", F.concat_ws("|", *group))


def native_tables(spark: SparkSession, path: str, year: str, allowed: Sequence[int], gate: Column, columns: Sequence[str]) -> DataFrame:
    """Rows of a table partitioned by year that pass ``gate``. The years of the partitions are seen before any value is read;
    one outside ``allowed`` refuses the whole table."""
    table = spark.read.parquet(path)
    found = {r[0] for r in table.select(year).distinct().collect()}  # from the folders' names
    if outside := found - set(allowed):
        raise ContractError(f"years outside the boundary: {sorted(outside)}")
    return table.filter(gate).select(*columns)


def ellipsoid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the geodesic on the ellipsoid by Lambert's formula: within 10 m over thousands of kilometres."""
    a, f = 6378.137, 1 / 298.257223563  # fixed: axis (km) and flattening of the ellipsoid
    p1, p2 = (F.atan((1 - f) * F.tan(F.radians(v))) for v in (lat1, lat2))
    d_lon, d_lat = F.radians(lon2 - lon1), p2 - p1
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(d_lon / 2), 2)
    angle = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (p1 + p2) / 2, d_lat / 2
    first = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q) / F.cos(angle / 2), 2)
    second = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q) / F.sin(angle / 2), 2)
    return F.when(angle == 0, 0.0).otherwise(a * (angle - f / 2 * (first + second)))
