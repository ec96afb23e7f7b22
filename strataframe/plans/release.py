"""Gates of new cohorts, audits of what was published, lookups, overlays, partitions, text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import contracts, metrics, release, splits, windows
from ..session import load
from ..sources import readers, sinks
from ..store import new_path, written
from .accuracy import LEVELS, _weights_sql
from .registry import query
from .spatial import resample
from .temporal import events
from .views import GRID_SQL, HOURLY_SQL, PREDICTED_SQL, SAMPLES_SQL, grid, hourly_events, predicted, samples, stations


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# a fine label's columns, made from a sample's: the same text serves Spark and the SQL beside it
_FINE = (
    ("lst", "CASE WHEN sample_id % 97 <> 0 THEN observed END"), ("screened", "sample_id % 89 <> 0"), ("land", "0.5e0 + (sample_id % 100) / 1e2"), ("classified", "0.9e0 + (sample_id % 17) / 1e2"), ("water", "(sample_id % 41) / 5e2"),
    ("climate", "CASE WHEN sample_id % 53 = 0 THEN 'Unknown' WHEN sample_id % 59 <> 0 THEN product END"), ("age_minutes", "(sample_id % 1000) / 1e1"), ("distance_km", "(acquisition_id % 110) * 1e0"), ("station_status", "CASE WHEN sample_id % 61 = 0 THEN 'pending' ELSE 'verified' END"),
    ("first_days", "CASE WHEN sample_id % 67 <> 0 THEN (sample_id % 34) - 0e0 END"), ("last_days", "(sample_id % 31) - 0e0"), ("elevation", "(acquisition_id % 120) - 30e0"), ("declared", "CASE WHEN acquisition_id % 120 >= 40 OR acquisition_id % 7 = 0 THEN 'day' ELSE 'night' END"),
    ("spatial_holdout", "acquisition_id % 19 = 0"), ("in_buffer", "acquisition_id % 23 = 0"), ("fit_support", "sample_id % 71 <> 0"), ("digest", "CASE WHEN sample_id % 73 <> 0 THEN md5(product) || md5(surface) ELSE 'none' END"),
)
_PHASE = "CASE WHEN elevation >= 10 THEN 'day' WHEN elevation <= -6 THEN 'night' ELSE 'twilight' END"
_FINE_SQL = f"{PREDICTED_SQL}, fine0 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FINE)} FROM predicted), fine AS (SELECT *, {_PHASE} AS light FROM fine0)"


def fine(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).selectExpr("*", *(f"{v} AS {k}" for k, v in _FINE)).withColumn("light", F.expr(_PHASE))


#: Fixed: the order of admission checks and their reasons.
_ADMIT = (
    ("lst IS NOT NULL", "nonfinite_label"), ("surface <> '5-LOW'", "not_an_approved_fine_product"), ("screened", "fine_source_screen_incomplete"), ("land >= 0.8", "insufficient_independent_land_fraction"), ("water <= 0.05", "independent_water_fraction_exceeds_five_percent"),
    ("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND balance IS NOT NULL", "incomplete_base40"), ("lower(climate) NOT IN ('', 'unknown', '__unknown__', 'nan', 'none', '0')", "unknown_climate"), ("b IS NOT NULL", "no_actual_station_pair"),
    ("age_minutes BETWEEN 0 AND 90", "station_time_mismatch"), ("distance_km BETWEEN 0 AND 100", "station_distance_mismatch"), ("station_status = 'verified'", "unverified_actual_station_report"), ("first_days BETWEEN 0 AND 32 AND last_days BETWEEN 0 AND 32", "missing_future_or_stale_optical"),
    ("first_days >= last_days", "inverted_optical_time_interval"), ("light <> 'twilight'", "unsupported_twilight"), ("declared = light", "declared_phase_disagrees_with_per_cell_solar_geometry"),
)
_FIT = (("year(ts) IN (1996, 1997, 1998)", "evaluation_year"), ("region_id <> 'NATION_3'", "withheld_region"), ("NOT spatial_holdout", "spatial_holdout"), ("NOT in_buffer", "holdout_buffer"), ("fit_support", "native_support_intersects_geographic_exclusion"))
_EVAL = (("year(ts) = 1999", "not_new_evaluation_year"), ("NOT in_buffer", "holdout_buffer"))
_SPLIT = "CASE WHEN region_id = 'NATION_3' THEN 'heldout_region' WHEN spatial_holdout THEN 'heldout_spatial' WHEN in_buffer THEN 'buffer' WHEN year(ts) IN (1996, 1997, 1998) THEN 'fit' WHEN month(ts) <= 6 THEN 'development' ELSE 'calibration' END"


def _ladder_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{r}'" for c, r in rules) + " END"


@query(f"WITH {_FINE_SQL}, r AS (SELECT *, {_ladder_sql(_ADMIT)} AS reason FROM fine) SELECT sample_id, reason, coalesce(reason, {_ladder_sql(_FIT)}) AS fit_reason, coalesce(reason, {_ladder_sql(_EVAL)}) AS evaluation_reason, {_SPLIT} AS split FROM r")
def flt_03_full_admission(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a fine label in their order, then those of fitting and of evaluation."""
    rules = lambda pairs: [(F.expr(c), r) for c, r in pairs]
    out = splits.admit(fine(spark, d), rules(_ADMIT), rules(_FIT), rules(_EVAL))
    return out.select("sample_id", "reason", "fit_reason", "evaluation_reason", F.expr(_SPLIT).alias("split"))


#: Fixed: the nine codes of support, 0 for none of the rules, then by number.
_SUPPORT = (
    "NOT (acquisition_id % 31 <> 0)", "classified IS NULL OR classified < 0.95", "land IS NULL OR land < 0.8", "water IS NOT NULL AND water <> 0", "a IS NULL OR balance IS NULL", "coalesce(climate, '') NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')",
    "elevation > -6 AND elevation < 10", "NOT coalesce(age_minutes BETWEEN 0 AND 90 AND distance_km BETWEEN 0 AND 100 AND b IS NOT NULL AND station_status = 'verified', false)",
)


@query(f"WITH {_FINE_SQL} SELECT sample_id, CAST(CASE {' '.join(f'WHEN {c} THEN {i}' for i, c in enumerate(_SUPPORT, 1))} ELSE 0 END AS INT) AS code FROM fine")
def flt_05_all_support_codes(spark: SparkSession, d: str) -> DataFrame:
    return fine(spark, d).select("sample_id", release.support_code([F.expr(c) for c in _SUPPORT]).cast("int").alias("code"))


_RAW = {"qc": "(l_orderkey * 3 + l_partkey) & 65472", "lst": "(l_partkey * 37) % 20500", "error": "l_suppkey % 60", "view": "(l_linenumber * 17) % 75", "ocean": "CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END"}
_GATES_SQL = {
    "mandatory_ok": "(qc & 3) = 0", "data_ok": "((qc >> 2) & 3) = 0", "cloud_clear": "((qc >> 4) & 3) = 0", "error_class_ok": "((qc >> 14) & 3) >= 2", "error_ok": "error > 0 AND error * 0.04 <= 1.5", "view_ok": "view <= 60", "land": "ocean = 0", "lst_range": "lst <> 0 AND lst * 0.02 >= 150 AND lst * 0.02 <= 400",
}


@query(f"WITH w AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({v} AS INT) AS {k}' for k, v in _RAW.items())} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS {k}' for k, v in _GATES_SQL.items())}, {' AND '.join(f'({v})' for v in _GATES_SQL.values())} AS native_qa_valid, round(CASE WHEN lst <> 0 THEN lst * 0.02 - 273.15 END, 4) AS lst_c FROM w")
def flt_08_swath_gates(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"CAST({v} AS INT) AS {k}" for k, v in _RAW.items()))
    gates = release.swath_gates(*(F.col(c) for c in _RAW))
    return w.select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in gates.items()), E.all_of(list(gates.values())).alias("native_qa_valid"), F.round(F.when(F.col("lst") != 0, F.col("lst") * 0.02 - 273.15), 4).alias("lst_c"))


@query(f"WITH {GRID_SQL}, k AS (SELECT a.row, a.col, count(*) AS n FROM grid a JOIN grid b ON b.size <= 48 AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2) SELECT grid.row, grid.col, CASE WHEN size > 48 THEN 'first_qa_plane' WHEN NOT value BETWEEN 905 AND 5000 THEN 'implausible' WHEN coalesce(n, 0) < 9 THEN 'in_nodata_buffer' END AS reason FROM grid LEFT JOIN k ON k.row = grid.row AND k.col = grid.col")
def flt_10_nodata_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A cell near one that is not good, or near the scene's edge, is not clear."""
    cells = release.clear_of_gaps(grid(spark, d), "row", "col", F.col("size") <= 48, 100.0, 150.0)
    rules = [(F.col("size") > 48, "first_qa_plane"), (~F.col("value").between(905, 5000), "implausible"), (~F.col("clear"), "in_nodata_buffer")]
    return cells.select("row", "col", E.first_reason(rules).alias("reason"))


_SOURCES = ("313", "314", "315", "322", "335", "343", "344", "346", "220", "221", "222", "223", "347", "348", "345", "382")
_VARIABLES = ("temperature", "relative_humidity", "wind_speed")
_CODED = {"variable": f"element_at(array({', '.join(map(repr, _VARIABLES))}), CAST(l_linenumber % 3 AS INT) + 1)", "source": f"element_at(array({', '.join(map(repr, _SOURCES))}), CAST(l_suppkey % 16 AS INT) + 1)", "code": "CASE WHEN l_partkey % 11 = 10 THEN ' ' ELSE CAST(l_partkey % 11 AS STRING) END"}
_CODED_SQL = {k: v.replace("array(", "list_value(").replace("element_at(", "list_extract(").replace("STRING", "VARCHAR") for k, v in _CODED.items()}
_PASS_SQL = " OR ".join(f"(source IN {s if len(s) > 1 else f'({s[0]!r})'} AND code IN {c if len(c) > 1 else f'({c[0]!r})'}{f' AND variable IN {v}' if v else ''})" for s, v, c in readers.PASSING_CODES)


@query(f"WITH r AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CODED_SQL.items())} FROM lineitem) SELECT variable, source, trim(code) AS code, trim(code) = '' OR {_PASS_SQL} AS usable, count(*) AS n FROM r GROUP BY ALL")
def flt_11_code_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Quality codes by source and variable."""
    r = load(spark, d, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in _CODED.items()))
    usable = readers.quality_usable(F.col("variable"), F.col("code"), F.col("source"))
    return r.groupBy("variable", "source", F.trim("code").alias("code"), usable.alias("usable")).agg(F.count(F.lit(1)).alias("n"))


_NEW_RULES = (("lst IS NOT NULL", "not_admitted"), ("screened", "no_source_screen"), ("fit_support", "no_fit_support"), ("length(digest) = 64", "no_source_digest"), ("year(ts) IN (1996, 1997, 1998)", "outside_years"), ("surface <> '5-LOW'", "not_a_fine_label"), ("a IS NOT NULL AND balance IS NOT NULL AND light <> 'twilight'", "incomplete_predictors"), ("NOT in_buffer", "holdout_buffer"))


@query(f"""WITH {_FINE_SQL}, ref AS (SELECT sample_id, acquisition_id, surface FROM fine WHERE year(ts) < 1996 OR sample_id % 211 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY acquisition_id, surface) > 1 AS twice FROM fine WHERE year(ts) >= 1996)
SELECT n.sample_id, coalesce({_ladder_sql(_NEW_RULES)}, CASE WHEN sample_id IN (SELECT sample_id FROM ref) THEN 'known_identity' WHEN twice THEN 'repeated_cell' WHEN (acquisition_id, surface) IN (SELECT (acquisition_id, surface) FROM ref) THEN 'known_cell' END) AS reason FROM n""")
def flt_23_label_revalidation(spark: SparkSession, d: str) -> DataFrame:
    f = written(fine(spark, d), "cells")  # read for the new rows, for both sides of the reference and for the cells
    reference = f.filter((F.year("ts") < 1996) | (F.col("sample_id") % 211 == 0))
    return release.revalidated(f.filter(F.year("ts") >= 1996), reference, [(F.expr(c), r) for c, r in _NEW_RULES], "sample_id", ["acquisition_id", "surface"]).select("sample_id", "reason")


_BATCH = "date_trunc('hour', ts) + CASE WHEN event_id % 997 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END"


@query(f"""WITH r AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS batch, {_BATCH} AS stamp, (event_id * 7 % 18100) / 1e2 - 90.5 AS lat, (event_id * 13 % 36050) / 1e2 - 180 AS lon, date_trunc('hour', ts) AS valid, user_id FROM events),
c AS (SELECT batch, count(*) AS rows, count(*) FILTER (WHERE stamp <> valid) AS off_hour, count(*) FILTER (WHERE NOT lat BETWEEN -90 AND 90) AS bad_latitude, count(*) FILTER (WHERE NOT lon BETWEEN -180 AND 180) AS bad_longitude, bool_and(CAST(substr(batch, 12, 2) AS INT) <> 5) AS enabled FROM r GROUP BY 1)
SELECT *, enabled AND off_hour + bad_latitude + bad_longitude = 0 AS accepted FROM c""")
def flt_25_exact_hour_gate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    batch = F.date_format("ts", "yyyy-MM-dd HH")
    rows = e.select(batch.alias("batch"), F.expr(_BATCH).alias("at"), ((F.col("event_id") * 7 % 18100) / 100 - 90.5).alias("lat"), ((F.col("event_id") * 13 % 36050) / 100 - 180).alias("lon"))
    plan = e.select(batch.alias("batch"), F.date_trunc("hour", "ts").alias("valid_ts")).distinct().withColumn("enabled", F.substring("batch", 12, 2) != "05")
    return release.exact_hour_gate(rows, plan, "batch", "at", "lat", "lon")


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'observed' WHEN 1 THEN 'experimental' WHEN 2 THEN 'scenario' WHEN 3 THEN 'experimental' ELSE 'guess' END AS mode, o_orderdate AS requested, o_orderdate - to_days(CAST(o_custkey % 120 - 8 AS INT) * CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 0 ELSE 1 END) AS source FROM orders),
a AS (SELECT *, epoch(requested - source) / 86400 AS age FROM t)
SELECT o_orderkey, CASE WHEN mode = 'guess' THEN 'unknown_mode' WHEN mode = 'scenario' THEN NULL WHEN NOT (year(requested) IN (1996, 1997, 1998) AND year(source) IN (1996, 1997, 1998)) THEN 'outside_pilot_years' WHEN age < 0 THEN 'future_source' WHEN mode = 'observed' AND age <> 0 THEN 'not_the_source_time' WHEN age > 90 THEN 'stale_source' END AS reason, round(age, 6) + 0.0 AS age_days FROM a""")
def flt_28_requested_time(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    days = ((F.col("o_custkey") % 120 - 8) * F.when((k == 0) & (F.col("o_custkey") % 2 == 0), 0).otherwise(1)).cast("int")
    t = load(spark, d, "orders").select("o_orderkey", F.when(k == 0, "observed").when(k == 2, "scenario").when(k == 4, "guess").otherwise("experimental").alias("mode"), F.col("o_orderdate").alias("requested"), (F.col("o_orderdate") - F.make_dt_interval(days)).alias("source"))
    reason, age = release.requested_time(F.col("mode"), F.col("requested"), F.col("source"), (1996, 1997, 1998))
    return t.select("o_orderkey", reason.alias("reason"), (F.round(age, 6) + 0.0).alias("age_days"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, observed, balance, round(0.5 * (1 + sin(radians((sample_id % 180) - 90))), 8) AS insolation, round(observed / (1 + abs(balance)), 8) AS seasonal FROM samples")
def prj_03_replace_calendar(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    frame = s.select("sample_id", "observed", "balance", F.month("ts").alias("month_sin"), F.quarter("ts").alias("month_cos"))
    values = s.select("sample_id", (0.5 * (1 + F.sin(F.radians((F.col("sample_id") % 180) - 90)))).alias("insolation"), (F.col("observed") / (1 + F.abs("balance"))).alias("seasonal"))
    out = release.replace_columns(frame, ["month_sin", "month_cos"], values, "sample_id", ["insolation", "seasonal"])
    return out.select("sample_id", "observed", "balance", _r("insolation", 8), _r("seasonal", 8))


@query(f"WITH {PREDICTED_SQL}, p AS (SELECT *, 12.5 + 0.9 * a + 0.0005 * balance AS pred, region_id || '|' || month AS batch FROM predicted), b AS (SELECT batch, count(*) FILTER (WHERE pred IS NULL) AS bad FROM p GROUP BY 1) SELECT sample_id, round(CASE WHEN bad = 0 THEN pred END, 6) AS prediction, CASE WHEN bad = 0 THEN 'predicted' ELSE 'refused_batch' END AS status FROM p JOIN b USING (batch)")
def ml_10_frozen_apply(spark: SparkSession, d: str) -> DataFrame:
    """A frozen linear model over batches of region and month; a batch with a row that can't be predicted is refused."""
    p = predicted(spark, d).withColumn("batch", F.concat_ws("|", "region_id", "month"))
    out = release.frozen_apply(p, "batch", ["a", "balance"], 12.5 + 0.9 * F.col("a") + 0.0005 * F.col("balance"))
    return out.select("sample_id", _r("prediction"), "status")


_STATIONS_SQL = f"""WITH {HOURLY_SQL}, l AS (SELECT event_id, user_id, ts, event_id * 7 % 100 * 1.0 AS x, h.value AS background FROM events LEFT JOIN hourly h ON h.key = 'signup' AND h.hour = date_trunc('hour', ts) WHERE event_type = 'purchase'),
s AS (SELECT DISTINCT user_id, event_type AS station_type, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS rank, CASE event_type WHEN 'view' THEN user_id * 31 % 100 ELSE user_id * 17 % 100 END * 1.0 AS sx FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT l.event_id, station_type, rank, sx, abs(x - sx) AS km, background, r.ts AS report_ts, r.value AS reported, epoch(l.ts - r.ts) / 60 AS age, row_number() OVER (PARTITION BY l.event_id, station_type ORDER BY r.ts DESC, r.event_id DESC) AS k FROM l JOIN s USING (user_id) JOIN events r ON r.user_id = l.user_id AND r.event_type = station_type AND r.ts <= l.ts AND epoch(l.ts - r.ts) <= 2880 * 60),
u AS (SELECT event_id, station_type, km, age, background + (reported - b.value) AS air, row_number() OVER (PARTITION BY event_id ORDER BY km, rank) AS k2 FROM m JOIN hourly b ON b.key = station_type AND b.hour = date_trunc('hour', report_ts) WHERE k = 1 AND km <= 60 AND abs(reported - b.value) <= 20 AND background IS NOT NULL)
SELECT l.event_id, station_type AS station, round(km, 6) AS station_km, round(age, 4) AS age_minutes, round(coalesce(air, background), 6) AS air, CASE WHEN air IS NULL THEN 'background_only' ELSE 'station_residual_plus_background' END AS source FROM l LEFT JOIN u ON u.event_id = l.event_id AND k2 = 1"""


@query(_STATIONS_SQL)
def jn_03_nearest_station_asof(spark: SparkSession, d: str) -> DataFrame:
    """Two stations an area (a user's views and clicks); the nearest usable one as of each time, else the background."""
    e, hours = events(spark, d), hourly_events(spark, d)
    here = hours.filter("key = 'signup'").select(F.col("hour").alias("__hour"), F.col("value").alias("background"))
    rows = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("event_id") * 7 % 100 * 1.0).alias("x"), F.date_trunc("hour", "ts").alias("__hour")).join(here, "__hour", "left").drop("__hour")
    seen = e.filter("event_type IN ('view', 'click')")
    name = F.concat_ws(":", "user_id", "event_type")
    place = F.when(F.col("event_type") == "view", F.col("user_id") * 31 % 100).otherwise(F.col("user_id") * 17 % 100) * 1.0
    offered = seen.select("user_id", name.alias("station"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("rank"), place.alias("sx"), F.col("event_type").alias("kind")).distinct()
    reports = seen.select(name.alias("station"), F.col("ts").alias("at"), F.col("value").alias("reported"), F.col("event_id").alias("report_id"))
    background = offered.select("station", "kind").join(hours.select(F.col("key").alias("kind"), "hour", F.col("value").alias("station_background")), "kind").select("station", "hour", "station_background")
    out = release.attach_stations(rows, offered.drop("kind"), reports, background, id_col="event_id", area="user_id", ts="ts", distance=F.abs(F.col("x") - F.col("sx")), most_km=60, most_minutes=2880)
    return out.select("event_id", F.substring_index("station", ":", -1).alias("station"), _r("station_km"), _r("age_minutes", 4), _r("air"), "source")


_PAIR = "s_suppkey, dx, dy, row, col"
_OVERLAY_SQL = f"""WITH {GRID_SQL}, q AS (SELECT s_suppkey, s_suppkey * 37 % 4500 * 1e0 AS x0, s_suppkey * 53 % 3500 * 1e0 AS y0, s_suppkey % 50 AS k FROM supplier),
m AS (SELECT s_suppkey, o.dx AS dx, o.dy AS dy, [x0 + o.dx, x0 + 400 + o.dx, x0 + 430 + o.dx, x0 - 60 + o.dx] AS xs, [y0 + o.dy, y0 + 30 + k + o.dy, y0 + 360 + o.dy, y0 + 290 + o.dy] AS ys FROM q, (SELECT unnest([{{'dx': 0e0, 'dy': 0e0}}, {{'dx': 9e1, 'dy': 0e0}}, {{'dx': 0e0, 'dy': -9e1}}]) AS o)),
a AS (SELECT *, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2 AS area, list_min(xs) AS mn, list_max(xs) AS mx FROM m),
p AS (SELECT a.*, row, col, value, size > 10 AS ok, x - 50 AS l, x + 50 AS r, y - 50 AS b, y + 50 AS t FROM a JOIN grid ON x + 50 > mn AND x - 50 < mx AND y + 50 > list_min(ys) AND y - 50 < list_max(ys)),
e AS (SELECT {_PAIR}, l, r, b, t, mn, mx, xs[i] AS ax, ys[i] AS ay, xs[i % 4 + 1] AS bx, ys[i % 4 + 1] AS dy2 FROM p, (SELECT unnest([1, 2, 3, 4]) AS i)),
k AS (SELECT DISTINCT {_PAIR}, greatest(l, mn, least(r, mx, v)) AS v FROM (SELECT *, unnest([l, r, ax, CASE WHEN dy2 <> ay THEN ax + (b - ay) / (dy2 - ay) * (bx - ax) END, CASE WHEN dy2 <> ay THEN ax + (t - ay) / (dy2 - ay) * (bx - ax) END]) AS v FROM e) WHERE v IS NOT NULL),
h AS (SELECT {_PAIR}, v, greatest(0, least(max(t), max(ay + (v - ax) / (bx - ax) * (dy2 - ay))) - greatest(max(b), min(ay + (v - ax) / (bx - ax) * (dy2 - ay)))) AS h FROM k JOIN e USING ({_PAIR}) WHERE v BETWEEN least(ax, bx) AND greatest(ax, bx) GROUP BY {_PAIR}, v),
s AS (SELECT {_PAIR}, (lead(v) OVER n - v) * (h + lead(h) OVER n) / 2 AS part FROM h WINDOW n AS (PARTITION BY {_PAIR} ORDER BY v)), w AS (SELECT {_PAIR}, sum(part) AS w FROM s GROUP BY {_PAIR} HAVING sum(part) > 1e-9)
SELECT s_suppkey, dx, dy, round(sum(w * value) FILTER (WHERE ok) / sum(w) FILTER (WHERE ok), 6) AS mean, round(coalesce(sum(w) FILTER (WHERE ok), 0) / max(area), 6) AS valid_fraction, count(*) FILTER (WHERE ok) AS cells FROM w JOIN p USING ({_PAIR}) GROUP BY 1, 2, 3"""


@query(_OVERLAY_SQL)
def jn_18_polygon_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Convex quadrilaterals over the grid, as given and shifted. The SQL integrates the height in common between the places
    where it bends."""
    k = F.col("s_suppkey")
    x0, y0 = (k * 37 % 4500).cast("double"), (k * 53 % 3500).cast("double")
    quads = load(spark, d, "supplier").select("s_suppkey", F.array(x0, x0 + 400, x0 + 430, x0 - 60).alias("xs"), F.array(y0, y0 + 30 + k % 50, y0 + 360, y0 + 290).alias("ys"))
    out = release.polygon_overlay(grid(spark, d), quads, 100.0, "s_suppkey", "value", F.col("size") > 10, [(0, 0), (90, 0), (0, -90)])
    return out.select("s_suppkey", "dx", "dy", _r("mean"), _r("valid_fraction"), "cells")


@query(f"WITH {GRID_SQL} SELECT row * 50 + col AS position, row, col, round(value, 6) AS label, 'block_7' AS block, 'scene_' || brand AS scene FROM grid WHERE size > 20")
def jn_29_label_by_position(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("position", F.col("row") * 50 + F.col("col"))
    raster = g.select("position", F.when(F.col("size") > 20, F.col("value")).alias("observed"))
    out = release.labels_by_position(g.select("position", "row", "col", "brand"), raster, "position", "observed", {"block": F.lit("block_7"), "scene": F.concat(F.lit("scene_"), F.col("brand"))})
    return out.select("position", "row", "col", _r("label"), "block", "scene")


_QUAD = "[[0.0, 0.0], [30.0 + s_suppkey % 7, 5.0], [25.0, 40.0 + s_suppkey % 11], [-5.0, 30.0]]"


@query(f"""WITH q AS (SELECT s_suppkey, {_QUAD} AS v FROM supplier), p AS (SELECT s_suppkey, v, -10 + (i + 0.5) * 50 / 80 AS x, -5 + (j + 0.5) * 60 / 80 AS y FROM q, (SELECT unnest(range(0, 80)) AS i), (SELECT unnest(range(0, 80)) AS j)),
t AS (SELECT s_suppkey, x, y, v, unnest(range(1, 5)) AS i FROM p), s AS (SELECT s_suppkey, x, y, bool_and((v[i % 4 + 1][1] - v[i][1]) * (y - v[i][2]) - (v[i % 4 + 1][2] - v[i][2]) * (x - v[i][1]) >= 0) AS inside FROM t GROUP BY 1, 2, 3) SELECT s_suppkey, round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY 1""")
def jn_30_footprint_share(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    scenes = load(spark, d, "supplier").select("s_suppkey", F.array(F.lit(0.0), 30.0 + k % 7, F.lit(25.0), F.lit(-5.0)).alias("xs"), F.array(F.lit(0.0), F.lit(5.0), 40.0 + k % 11, F.lit(30.0)).alias("ys"))
    return release.footprint_share(scenes, "s_suppkey", "xs", "ys", [F.lit(-10.0), F.lit(-5.0), F.lit(40.0), F.lit(55.0)]).select("s_suppkey", _r("share"))


@query("SELECT CASE WHEN o_orderkey % 23 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN 'area_differs' WHEN o_orderkey % 19 = 0 THEN 'midpoint_differs' ELSE 'matched' END AS status, count(*) AS n FROM orders GROUP BY 1")
def jn_31_midpoint_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 6 MINUTES")).alias("stop"), F.col("o_totalprice").alias("area"))
    late = F.when(k % 19 == 0, F.expr("INTERVAL 181 SECONDS")).otherwise(F.expr("INTERVAL 180 SECONDS"))
    other = rows.filter(k % 23 != 0).select("o_orderkey", (F.col("start") + late).alias("at"), (F.col("area") + F.when(k % 17 == 0, 1).otherwise(0)).alias("its_area"))
    return release.midpoint_audit(rows, other, "o_orderkey", "start", "stop", "area").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT DISTINCT CAST(p_size AS INT) AS row, CAST(p_partkey % 72 AS INT) AS col, min(CAST(p_partkey % 33 AS INT)) AS code FROM part GROUP BY 1, 2), s AS (SELECT s_suppkey AS station_id, s_suppkey * 7919 % 1200 / 10.0 - 60 AS lat, s_suppkey * 104729 % 3600 / 10.0 - 180 AS lon FROM supplier),
j AS (SELECT station_id, code FROM s LEFT JOIN g ON g.row = CAST(floor((90 - lat) * 0.2 + 0.5) AS INT) AND g.col = CAST(floor(((lon % 360 + 360) % 360) * 0.2 + 0.5) AS INT) % 72)
SELECT station_id, CASE WHEN code BETWEEN 1 AND 30 THEN code END AS code, CASE WHEN code BETWEEN 1 AND 30 THEN 'classified' ELSE 'unknown_or_nodata' END AS status FROM j""")
def src_18_climate_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Climate classes of a coarse grid, looked up by the stations' nearest cell; cells without a code are unknown."""
    classes = load(spark, d, "part").groupBy(F.col("p_size").cast("int").alias("row"), (F.col("p_partkey") % 72).cast("int").alias("col")).agg(F.min((F.col("p_partkey") % 33).cast("int")).alias("code"))
    row, col = E.nearest_index(F.col("lat"), F.col("lon"), 0.2)
    out = release.class_lookup(stations(spark, d), classes, row, col, "code")
    number = F.create_map(*(F.lit(v) for i, name in enumerate(E.CLIMATE_CLASSES, 1) for v in (name, i)))
    return out.select("station_id", number[F.col("class")].alias("code"), "status")


# audits and intervals


@query(f"""WITH {PREDICTED_SQL}, l AS (SELECT *, b + CASE WHEN region_id = 'NATION_5' AND sample_id % 40 = 0 THEN 200 ELSE 0 END AS g, sample_id % 3 <> 0 AS ok FROM predicted WHERE a IS NOT NULL AND region_id <> 'NATION_9'), l2 AS (SELECT *, CASE WHEN ok OR (region_id = 'NATION_6' AND sample_id % 50 = 0) THEN g ELSE a END AS h FROM l),
p AS (SELECT region_id, count(*) + CASE WHEN region_id = 'NATION_2' THEN 1 ELSE 0 END AS n, count(DISTINCT utc_day) AS dates, avg(abs(h - observed)) + CASE WHEN region_id = 'NATION_4' THEN 1e-3 ELSE 0 END AS mae, count(*) AS n0, avg(abs(h - observed)) AS mae0, max(abs(h - a)) AS most, count(*) FILTER (WHERE NOT ok AND abs(h - a) > 1e-9) AS moved FROM l2 GROUP BY 1)
SELECT region_id, CASE WHEN n <> n0 THEN 'counts_differ' WHEN abs(mae - mae0) > 1e-9 THEN 'mae_differs' WHEN most > 150 + 1e-9 THEN 'correction_exceeds_limit' WHEN moved > 0 THEN 'unsupported_rows_changed' ELSE 'reproduced' END AS status FROM p WHERE region_id <> 'NATION_8'
UNION ALL SELECT 'NATION_9', 'no_such_observations' UNION ALL SELECT 'NATION_8', 'not_published' WHERE EXISTS (SELECT 1 FROM l2 WHERE region_id = 'NATION_8')""")
def agg_34_replay_audit(spark: SparkSession, d: str) -> DataFrame:
    """What was published by region against the ledger: wrong counts, wrong errors, corrections beyond their bound."""
    p = predicted(spark, d).filter("a IS NOT NULL AND region_id <> 'NATION_9'")
    moved = F.col("b") + F.when((F.col("region_id") == "NATION_5") & (F.col("sample_id") % 40 == 0), 200).otherwise(0)
    ok = F.col("sample_id") % 3 != 0
    ledger = written(p.withColumn("ok", ok).withColumn("h", F.when(ok | ((F.col("region_id") == "NATION_6") & (F.col("sample_id") % 50 == 0)), moved).otherwise(F.col("a"))).select("region_id", "utc_day", "observed", "a", "h", "ok"), "ledger")
    saved = ledger.groupBy("region_id").agg((F.count(F.lit(1)) + F.when(F.col("region_id") == "NATION_2", 1).otherwise(0)).alias("n"), F.count_distinct("utc_day").alias("date_count"), (F.avg(F.abs(F.col("h") - F.col("observed"))) + F.when(F.col("region_id") == "NATION_4", 1e-3).otherwise(0.0)).alias("mae"))
    saved = saved.filter("region_id <> 'NATION_8'").union(load(spark, d, "nation").filter("n_name = 'NATION_9'").select("n_name", F.lit(5).cast("long"), F.lit(2).cast("long"), F.lit(1.0)))
    return release.replay_audit(ledger, saved, ["region_id"], ["utc_day"], "observed", "a", "h", "ok", 150)


_NINE = ("mae", "bias", "gt20", "gt50", "gt100", "contrast_mae", "plain_mae", "plain_gt50", "plain_gt100")
_DRAWS, _SEED = 2000, 2708


@query(f"""WITH {PREDICTED_SQL}, ok AS (SELECT * FROM predicted WHERE a IS NOT NULL AND b IS NOT NULL), {_weights_sql('ok')},
e AS (SELECT *, b - observed AS eb, a - observed AS ea, sum((b - observed) * weight) OVER q / sum(weight) OVER q AS mb, sum((a - observed) * weight) OVER q / sum(weight) OVER q AS ma FROM w WINDOW q AS (PARTITION BY region_id, acquisition_id)),
y AS (SELECT utc_day, sum(weight) AS w, CAST(count(*) AS DOUBLE) AS n, sum((abs(eb) - abs(ea)) * weight) AS d0, sum((eb - ea) * weight) AS d1, {', '.join(f'sum(((CASE WHEN abs(eb) > {t} THEN 1.0 ELSE 0.0 END) - (CASE WHEN abs(ea) > {t} THEN 1.0 ELSE 0.0 END)) * weight) AS d{i}' for i, t in ((2, 20), (3, 50), (4, 100)))},
  sum((abs(eb - mb) - abs(ea - ma)) * weight) AS d5, sum(abs(eb) - abs(ea)) AS d6, {', '.join(f'sum((CASE WHEN abs(eb) > {t} THEN 1.0 ELSE 0.0 END) - (CASE WHEN abs(ea) > {t} THEN 1.0 ELSE 0.0 END)) AS d{i}' for i, t in ((7, 50), (8, 100)))} FROM e GROUP BY 1),
z AS (SELECT *, row_number() OVER (ORDER BY utc_day) - 1 AS pos, count(*) OVER () AS n_dates FROM y), k AS (SELECT draw, CAST('0x' || substr(md5('{_SEED}:' || draw || ':' || slot), 1, 15) AS BIGINT) % (SELECT max(n_dates) FROM z) AS pos FROM (SELECT unnest(range(0, {_DRAWS})) AS draw), (SELECT unnest(range(0, (SELECT max(n_dates) FROM z))) AS slot)),
t AS (SELECT draw, pos, count(*) AS c FROM k GROUP BY 1, 2), s AS (SELECT draw, sum(c * w) AS w, sum(c * n) AS n, {', '.join(f'sum(c * d{i}) AS d{i}' for i in range(9))} FROM t JOIN z USING (pos) GROUP BY 1),
r AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, d{i} / {'w' if i < 6 else 'n'} AS v FROM s" for i, m in enumerate(_NINE))}) SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r GROUP BY 1""")
def agg_15_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Nine paired metrics of two models, 2,000 draws of whole dates shared by both."""
    ok = predicted(spark, d).filter("a IS NOT NULL AND b IS NOT NULL").select("region_id", "phase", "utc_day", "acquisition_id", "surface", "observed", "a", "b")
    weighted = written(windows.balanced_weights(ok, LEVELS), "weighted")
    daily = None
    for model in "ab":
        rows, parts = release.date_contributions(weighted, F.col(model), F.col("observed"), "weight", ["region_id", "acquisition_id"], (20, 50, 100))
        sums = rows.select("utc_day", "weight", *parts).groupBy("utc_day").agg(*(F.sum(f"m{i}").alias(f"{model}{i}") for i in range(9)), *([F.sum("weight").alias("w"), F.count(F.lit(1)).cast("double").alias("n")] if model == "a" else []))
        daily = sums if daily is None else daily.join(sums, "utc_day")
    daily = daily.select("utc_day", "w", "n", *((F.col(f"b{i}") - F.col(f"a{i}")).alias(f"d{i}") for i in range(9)))
    out = release.date_bootstrap(daily, "utc_day", {m: (f"d{i}", "w" if i < 6 else "n") for i, m in enumerate(_NINE)}, ["w", "n"], _DRAWS, _SEED)
    return out.select("metric", _r("low"), _r("high"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT grid.*, cx, cy, greatest(0, least(x + 50, (cx + 1) * 500.0) - greatest(x - 50, cx * 500.0)) * greatest(0, least(y + 50, (cy + 1) * 500.0) - greatest(y - 50, cy * 500.0)) AS w FROM grid, (SELECT CAST(unnest(range(0, 11)) AS INT) AS cx), (SELECT CAST(unnest(range(0, 90)) AS INT) AS cy)),
g AS (SELECT cx, cy, coalesce(sum(CASE WHEN size > 9 THEN w END), 0) / 250000 AS f, sum(CASE WHEN size > 9 THEN w * value END) / sum(CASE WHEN size > 9 THEN w END) AS m FROM c WHERE w > 0 GROUP BY 1, 2) SELECT cx, cy, round(CASE WHEN f >= 0.8 THEN m END, 6) AS mean, CAST(CASE WHEN f >= 0.999999 THEN 0 WHEN f >= 0.8 THEN 1 WHEN f > 0 THEN 2 ELSE 3 END AS INT) AS quality FROM g""")
def agg_25_coarser_export(spark: SparkSession, d: str) -> DataFrame:
    """Means over 500 m where 80 % of the area is valid, with a code: whole, enough, too little, none."""
    out = resample(grid(spark, d), 500.0, 100.0, "value", F.col("size") > 9, 0.8)
    f = F.col("valid_fraction")
    return out.select("cx", "cy", _r("mean"), E.ladder([(f >= 0.999999, 0), (f >= 0.8, 1), (f > 0, 2)], 3).cast("int").alias("quality"))


@query(f"WITH {HOURLY_SQL}, m AS (SELECT key, date_trunc('month', hour) AS month, count(*) AS n, count(DISTINCT CAST(hour AS DATE)) AS days FROM hourly GROUP BY 1, 2) SELECT key, strftime(month, '%Y-%m') AS month, n AS exact_hours, days, CAST(epoch(month + INTERVAL 1 MONTH) - epoch(month) AS BIGINT) // 3600 - n AS missing_hours FROM m")
def agg_36_month_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Hours delivered of each month, and those its length asks for."""
    m = hourly_events(spark, d).groupBy("key", F.trunc("hour", "month").alias("month")).agg(F.count(F.lit(1)).alias("exact_hours"), F.count_distinct(F.to_date("hour")).alias("days"))
    return m.select("key", F.date_format("month", "yyyy-MM").alias("month"), "exact_hours", "days", (F.dayofmonth(F.last_day("month")).cast("long") * 24 - F.col("exact_hours")).alias("missing_hours"))


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, abs(a - observed) AS r FROM predicted WHERE a IS NOT NULL), k AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM ok WHERE year(ts) = 1999), q AS (SELECT max(r) AS radius FROM k WHERE k = ceil((n + 1) * 0.9)), seen AS (SELECT DISTINCT month FROM ok WHERE year(ts) < 1999) SELECT sample_id, round(a - radius, 6) AS low, round(a + radius, 6) AS high, month NOT IN (SELECT month FROM seen) AS unseen FROM ok, q WHERE year(ts) >= 2000")
def ml_13_fitted_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The radius comes from the calibration year's residuals; categories that fitting never saw are marked."""
    ok = predicted(spark, d).filter("a IS NOT NULL").withColumns({"e": F.col("a") - F.col("observed"), "all": F.lit(1)})
    radius = metrics.order_radius(ok.filter(F.year("ts") == 1999), ["all"], "e", 0.9).first()
    seen = ok.filter(F.year("ts") < 1999).select("month").distinct().withColumn("seen", F.lit(True))
    r = F.lit(radius.radius if radius else None).cast("double")
    return ok.filter(F.year("ts") >= 2000).join(seen, "month", "left").select("sample_id", F.round(F.col("a") - r, 6).alias("low"), F.round(F.col("a") + r, 6).alias("high"), F.col("seen").isNull().alias("unseen"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, count(*) AS rows, bit_xor(CAST('0x' || substr(md5(CAST(sample_id AS VARCHAR)), 1, 15) AS BIGINT)) AS digest FROM samples GROUP BY 1, 2")
def agg_28_order_free_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each group's ids that adds up in any order, so no group is gathered."""
    h = F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 15), 16, 10).cast("long")
    return samples(spark, d).groupBy("region_id", "phase").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("digest"))


# partitions and registries


@query("SELECT sample_id, year(ts) <= 1996 AND NOT r AS train, year(ts) = 1997 AND month(ts) < 7 AND NOT r AS development, year(ts) = 1997 AND month(ts) >= 7 AND NOT r AS calibration, year(ts) = 1998 AS test, r AND year(ts) <= 1997 AS spatial_test FROM (SELECT o_orderkey AS sample_id, o_orderdate AS ts, o_custkey % 100 * 10.0 + 5 BETWEEN 150 AND 450 AND o_orderkey % 100 * 10.0 + 5 BETWEEN 250 AND 550 AS r FROM orders)")
def spl_09_block_partitions(spark: SparkSession, d: str) -> DataFrame:
    pts = load(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 100 * 10.0 + 5).alias("x"), (F.col("o_orderkey") % 100 * 10.0 + 5).alias("y"))
    return release.block_partitions(pts, "ts", "x", "y", (200, 300, 400, 500), 50, 1996).select("sample_id", "train", "development", "calibration", "test", "spatial_test")


_HELD = "(row // 10 + 2 * (col // 10)) % 5 = 0"


@query(f"WITH {GRID_SQL}, h AS (SELECT *, {_HELD} AS held FROM grid), near AS (SELECT DISTINCT a.row, a.col FROM h a JOIN h b ON b.held AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 AND sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) * 100 <= 200) SELECT h.row, h.col, CASE WHEN held THEN 'holdout' WHEN near.row IS NOT NULL THEN 'buffer' WHEN h.row % 10 = 0 OR h.col % 10 = 0 THEN 'boundary' ELSE 'fit_safe' END AS part FROM h LEFT JOIN near ON near.row = h.row AND near.col = h.col")
def spl_10_buffered_partition(spark: SparkSession, d: str) -> DataFrame:
    """Held blocks, cells within 200 m of one, cells at a block's edge, and the rest."""
    held = F.expr("(row div 10 + 2 * (col div 10)) % 5 = 0")
    cells = release.clear_of_gaps(grid(spark, d).withColumn("held", held), "row", "col", ~F.col("held"), 100.0, 200.0, absent_is_good=True)
    edge = (F.col("row") % 10 == 0) | (F.col("col") % 10 == 0)
    return cells.select("row", "col", E.ladder([(F.col("held"), "holdout"), (~F.col("clear"), "buffer"), (edge, "boundary")], "fit_safe").alias("part"))


@query(f"""WITH {SAMPLES_SQL}, g AS (SELECT DISTINCT region_id, CAST(utc_day AS VARCHAR) AS date, phase FROM samples) SELECT region_id, date, phase, CASE WHEN region_id < 'NATION_2' THEN 'original' ELSE 'catalogue' END AS family,
CASE WHEN region_id = 'NATION_1' THEN 'original_reference' WHEN region_id < 'NATION_2' THEN 'original_development' WHEN region_id < 'NATION_7' THEN 'new_development' ELSE 'reserved_new_geography' END AS geography_role, region_id || '|' || date || '|' || phase AS group_id FROM g""")
def spl_07_registry_roles(spark: SparkSession, d: str) -> DataFrame:
    groups = samples(spark, d).select("region_id", F.col("utc_day").cast("string").alias("date"), "phase").distinct()
    new = groups.filter("region_id >= 'NATION_2'").withColumn("role", F.when(F.col("region_id") < "NATION_7", "development_geography").otherwise("reserved_new_geography"))
    mapping = {"development_geography": "new_development", "reserved_new_geography": "reserved_new_geography"}
    return release.combine_registries(groups.filter("region_id < 'NATION_2'"), new, "region_id", ["region_id", "date", "phase"], "role", mapping, ["NATION_1"])


# sources and sinks


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name, length(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END) = 0 AS empty FROM supplier")
def src_02_text_table(spark: SparkSession, d: str) -> DataFrame:
    """A metadata table written as text and read back as text alone: an empty field is empty, not null (also SNK-03)."""
    path = new_path(spark, "metadata")
    sinks.write_metrics(load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("name")), path)
    rows = readers.strings_csv(spark, path)
    contracts.require(rows, {"all text": F.lit(all(t == "string" for _, t in rows.dtypes))})
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "name", (F.col("name") == "").alias("empty"))


@query(f"WITH {PREDICTED_SQL} SELECT region_id, count(*) AS n, round(avg(abs(a - observed)), 6) AS mae FROM predicted GROUP BY 1")
def snk_03_metric_table(spark: SparkSession, d: str) -> DataFrame:
    """A metric table written as CSV with a header, and what a reader of it gets."""
    path = new_path(spark, "metrics")
    sinks.write_metrics(predicted(spark, d).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("observed"))), 6).alias("mae")), path)
    return spark.read.csv(path, header=True, schema="region_id string, n long, mae double")


@query("SELECT o_orderstatus AS status, count(*) AS n, true AS second_refused FROM orders GROUP BY 1")
def snk_01_write_once(spark: SparkSession, d: str) -> DataFrame:
    """A table written once; writing there again is refused and changes nothing."""
    path = new_path(spark, "once")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_once(orders, path)
    refused = False
    try:
        sinks.write_once(orders.limit(0), path)
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("second_refused", F.lit(refused))


@query(f"WITH {SAMPLES_SQL} SELECT month, count(*) AS n FROM samples WHERE CAST(substr(month, 6, 2) AS INT) % 3 <> 0 GROUP BY 1")
def snk_04_pending_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts by month, every third of which is done under the same options: the others are still to do."""
    path, options = new_path(spark, "parts"), {"tolerance": 90, "version": 2}
    s = samples(spark, d).select("month", "sample_id")
    sinks.append_parts(s.filter(F.substring("month", 6, 2).cast("int") % 3 == 0), path, ["month"], options)
    done = sinks.read_parts(spark, path).withColumn("month", F.date_format("month", "yyyy-MM") if dict(sinks.read_parts(spark, path).dtypes)["month"] == "date" else F.col("month").cast("string"))
    return sinks.pending(s, done, ["month"], options).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS minute_end, count(*) AS n, round(sum(CASE WHEN event_type <> 'error' AND event_id % 31 <> 0 THEN round(value, 1) END), 1) AS total FROM events GROUP BY 1, 2")
def src_06_minute_text(spark: SparkSession, d: str) -> DataFrame:
    """Fixed text of each user's hour: two header lines, then year, day, month, day, hour, minute, value and code."""
    e = events(spark, d)
    line = F.concat_ws("  ", F.date_format("ts", "yyyy D M d H m"), F.when(F.col("event_id") % 31 == 0, "-9999.9").otherwise(F.round("value", 1).cast("string")), F.when(F.col("event_type") == "error", "1").otherwise("0"))
    text = F.concat(F.lit("station\n51.0 -1.0 100 m\n"), F.array_join(F.collect_list(line), "\n"))
    files = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(text.alias("text"))
    rows = readers.fixed_minutes(files.select("user_id", "text"), "text", ["value"])
    return rows.groupBy("user_id", F.date_format("minute_end_utc", "yyyy-MM-dd HH:mm").alias("minute_end")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("total"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'G' || o_orderkey END AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'no_identity' WHEN o_orderkey % 13 = 0 THEN 'no_start' WHEN o_orderkey % 7 = 0 THEN 'no_data_link' WHEN o_orderkey % 5 = 0 THEN 'no_phase_flag' END AS rejected_for,
CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 7 <> 0 THEN 'https://h/' || o_orderkey END AS link FROM orders""")
def src_08_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries made from orders: those that lack something are kept with the reason."""
    k = F.col("o_orderkey")
    link = F.struct(F.when(k % 7 == 0, "http://x/metadata#").otherwise("http://x/data#").alias("rel"), F.concat(F.lit("https://h/"), k).alias("href"))
    entry = F.struct(F.when(k % 11 != 0, F.concat(F.lit("G"), k)).alias("id"), F.concat(F.lit("T"), k).alias("title"), F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time_start"), F.when(k % 5 == 0, "UNSPECIFIED").otherwise("DAY").alias("day_night_flag"), F.array(link).alias("links"))
    raw = load(spark, d, "orders").select(F.to_json(entry).alias("json"))
    g = readers.granules(raw, "json")
    return g.select(F.substring("title", 2, 20).cast("long").alias("o_orderkey"), "id", "rejected_for", F.date_format("time_start", "yyyy-MM-dd").alias("day"), "link")


@query("SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def src_14_native_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables by year: the years are checked by folder names before a value is read; then the gate and two columns."""
    path = new_path(spark, "native")
    i = load(spark, d, "lineitem")
    i.select(F.year("l_shipdate").alias("year"), "l_quantity", "l_discount", "l_comment" if "l_comment" in i.columns else F.lit("").alias("l_comment")).write.partitionBy("year").parquet(path)
    rows = release.native_tables(spark, path, "year", range(1992, 2003), F.col("l_discount") > 0.05, ["year", "l_quantity"])
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


# scalar functions


@query("""WITH s AS (SELECT s_suppkey AS station_id, radians(s_suppkey * 7919 % 1200 / 10.0 - 60) AS f1, radians(s_suppkey * 523 % 1100 / 10.0 - 55) AS f2, radians(s_suppkey * 1301 % 900 / 10.0 - s_suppkey * 104729 % 900 / 10.0) AS dl FROM supplier),
b AS (SELECT station_id, atan((1 - 1 / 298.257223563) * tan(f1)) AS p1, atan((1 - 1 / 298.257223563) * tan(f2)) AS p2, dl FROM s),
g AS (SELECT *, 2 * asin(sqrt(least(1.0, pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2)))) AS w FROM b)
SELECT station_id, round(CASE WHEN w = 0 THEN 0 ELSE 6378.137 * (w - 1 / 298.257223563 / 2 * ((w - sin(w)) * pow(sin((p1 + p2) / 2) * cos((p2 - p1) / 2) / cos(w / 2), 2) + (w + sin(w)) * pow(cos((p1 + p2) / 2) * sin((p2 - p1) / 2) / sin(w / 2), 2))) END, 4) AS km FROM g""")
def sc_05_ellipsoid_distance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = lambda m, n, off: F.pmod(k * m, F.lit(n)) / 10.0 - off
    return load(spark, d, "supplier").select(k.alias("station_id"), F.round(release.ellipsoid_km(at(7919, 1200, 60), at(104729, 900, 0), at(523, 1100, 55), at(1301, 900, 0)), 4).alias("km"))


@query("WITH s AS (SELECT s_suppkey AS station_id, s_suppkey * 7919 % 1200 / 8.0 - 60 AS lat, s_suppkey * 104729 % 2880 / 8.0 - 180 AS lon FROM supplier) SELECT station_id, CAST(round_even(lat * 4, 0) AS INT) AS lat_cell, CAST(round_even(lon * 4, 0) AS INT) AS lon_cell, CAST(floor((90 - lat) * 4 + 0.5) AS INT) AS row FROM s")
def sc_22_cell_ties(spark: SparkSession, d: str) -> DataFrame:
    """Two rules for points halfway between nodes: to even, and up."""
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").select(k.alias("station_id"), (F.pmod(k * 7919, F.lit(1200)) / 8.0 - 60).alias("lat"), (F.pmod(k * 104729, F.lit(2880)) / 8.0 - 180).alias("lon"))
    return s.select("station_id", E.half_even_cell(F.col("lat"), 4).alias("lat_cell"), E.half_even_cell(F.col("lon"), 4).alias("lon_cell"), E.nearest_index(F.col("lat"), F.col("lon"), 4)[0].alias("row"))


_IDS = "CASE page_id % 4 WHEN 0 THEN '../' || page_id WHEN 1 THEN 'USW' || lpad(CAST(page_id AS {0}), 8, '0') WHEN 2 THEN 'a b' || page_id ELSE 'st_' || page_id END"


@query(f"WITH i AS (SELECT page_id, {_IDS.format('VARCHAR')} AS id, url FROM pages) SELECT page_id, regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}') AS safe, sha256(id || ':' || page_id || ':' || coalesce(url, '')) AS key FROM i")
def sc_29_safe_ids(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "pages").select("page_id", F.expr(_IDS.format("STRING")).alias("id"), "url")
    return i.select("page_id", E.safe_id(F.col("id")).alias("safe"), E.key_digest(F.col("id"), F.col("page_id"), F.coalesce("url", F.lit(""))).alias("key"))


@query("""SELECT o_orderkey, strftime(CASE o_orderkey % 5 WHEN 0 THEN TIMESTAMP '1990-01-01' + to_days(CAST(o_custkey AS INT)) WHEN 1 THEN TIMESTAMP '1990-01-01' + to_hours(o_custkey) WHEN 2 THEN TIMESTAMP '1990-01-01' + to_minutes(o_custkey) WHEN 3 THEN TIMESTAMP '1990-01-01' + to_seconds(o_custkey) END, '%Y-%m-%d %H:%M:%S') AS decoded,
CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS acquired FROM orders""")
def sc_36_decoded_times(spark: SparkSession, d: str) -> DataFrame:
    """Offsets in four units (any other is not decoded), and acquisition times: one instant or the start of a range, never both."""
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("days", "hours", "minutes", "seconds", "fortnights"))), (k % 5 + 1).cast("int"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    single, begin = F.when(k % 3 != 1, stamp), F.when(k % 3 != 2, stamp)
    o = load(spark, d, "orders").select(k, E.cf_time(F.col("o_custkey"), F.concat(unit, F.lit(" since 1990-01-01 00:00:00"))).alias("t"), E.acquisition_time(single, begin).alias("acquired"))
    return o.select("o_orderkey", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("decoded"), F.date_format("acquired", "yyyy-MM-dd").alias("acquired"))


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, c - observed AS e FROM predicted WHERE c IS NOT NULL), {_weights_sql('ok', 'product')} SELECT product, count(*) AS n, round(sum(weight * abs(e)), 8) AS mae, round(sqrt(sum(weight * e * e)), 8) AS rmse, round(sum(weight * e), 8) AS bias FROM w GROUP BY 1")
def udf_03_metric_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Balanced metrics as column helpers in a plain grouping."""
    ok = predicted(spark, d).filter("c IS NOT NULL").withColumn("e", F.col("c") - F.col("observed")).select("region_id", "phase", "utc_day", "acquisition_id", "surface", "product", "e")
    return windows.balanced_weights(ok, LEVELS, ["product"]).groupBy("product").agg(F.count(F.lit(1)).alias("n"), *(c for c in metrics.balanced_metrics(F.col("e"), F.col("weight"), 8)))
