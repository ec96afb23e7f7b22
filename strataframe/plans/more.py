"""Further operators of the inventory: gates, audits, metrics, memberships and physics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import contracts, estimate, joins, metrics, splits, windows
from ..session import load
from ..sources import readers
from ..store import new_path, written
from .accuracy import LEVELS, _weights_sql
from .registry import query
from .screening import solar_sql
from .temporal import events
from .views import GRID_SQL, HOURLY_SQL, PREDICTED_SQL, SAMPLES_SQL, STATIONS_SQL, grid, hourly_events, predicted, samples, stations


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# sources


@query("SELECT o_orderkey, o_totalprice FROM orders")
def src_01_guarded_scan(spark: SparkSession, d: str) -> DataFrame:
    """The time column is read and checked before anything else is."""
    return readers.guarded_scan(spark, f"{d}/orders.parquet", "o_orderdate", "1995-01-01", "2001-12-31").select("o_orderkey", "o_totalprice")


@query("""WITH b AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url || '?v=2' ELSE url END AS url FROM pages WHERE page_id % 3 <> 1), u AS (SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT * FROM b)
SELECT page_id, count(DISTINCT url) > 1 AS conflict, greatest(1, count(DISTINCT url)) AS versions, CASE WHEN count(DISTINCT url) = 1 THEN min(url) END AS url FROM u GROUP BY 1""")
def src_13_merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """Two shards that share a third of the pages, some of them with another address: those are conflicts."""
    p = load(spark, d, "pages").select("page_id", "url")
    second = p.filter("page_id % 3 <> 1").withColumn("url", F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url")))
    shards = [new_path(spark, "shard"), new_path(spark, "shard")]
    for path, rows in zip(shards, (p.filter("page_id % 3 <> 0"), second), strict=True):
        rows.write.parquet(path)
    rows, conflicts = readers.merged_shards(spark, shards, "page_id")
    one = rows.groupBy("page_id").agg(F.min("url").alias("first"))
    return one.join(conflicts, "page_id", "left").select("page_id", F.col("versions").isNotNull().alias("conflict"), F.coalesce("versions", F.lit(1)).cast("long").alias("versions"), F.when(F.col("versions").isNull(), F.col("first")).alias("url"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def src_16_distinct_targets(spark: SparkSession, d: str) -> DataFrame:
    """Metadata columns only, and the targets that they name."""
    return load(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(n_value, 6) AS node FROM (SELECT event_id, h.v AS n_value FROM events LEFT JOIN (SELECT user_id AS u, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2) h ON h.u = user_id AND h.day = date_trunc('day', events.ts))")
def src_11_grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A gridded value by time and nearest cell: an equality join on the cell's keys (also the climate lookup, SRC-18)."""
    nodes = load(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("node"))
    return load(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")).join(nodes, ["user_id", "day"], "left").select("event_id", _r("node"))


@query("SELECT l_orderkey % 1000 AS variable, min(l_partkey) AS record, count(*) AS copies FROM lineitem GROUP BY 1")
def src_17_forecast_index(spark: SparkSession, d: str) -> DataFrame:
    """Index lines written from the items, parsed back."""
    lines = load(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_partkey").cast("string"), F.lit("0"), F.lit("d=2024010100"), F.concat(F.lit("V"), (F.col("l_orderkey") % 1000).cast("string")), F.lit("surface"), F.lit("anl"), F.lit("")).alias("value"))
    return readers.forecast_index(lines).select(F.expr("CAST(substr(variable, 2) AS BIGINT)").alias("variable"), F.col("record").cast("long").alias("record"), "copies")


@query("SELECT s_suppkey, CAST(s_suppkey % 5 AS BIGINT) AS scene, s_suppkey % 3 <> 0 AS parsed FROM supplier")
def src_09_obstruction_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = load(spark, d, "supplier").select(F.concat_ws(" ", F.lpad((k + 10000).cast("string"), 5, "0"), F.lpad((k % 5).cast("string"), 3, "0"), F.when(k % 3 == 0, "garbled").otherwise("20240101T000000"), F.lit("yes")).alias("value"))
    out = readers.obstruction_list(lines)
    number = lambda column, i: F.regexp_extract(F.coalesce(column, F.col("bad_line")), r"^(\d{5})(?: (\d{3}))?", i).try_cast("long")
    return out.select((number(F.col("orbit"), 1) - 10000).alias("s_suppkey"), F.coalesce(F.col("scene").cast("long"), number(F.lit(None), 2)).alias("scene"), "parsed")


@query("SELECT o_custkey, status, count(*) AS n FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'time_differs' WHEN o_orderkey % 7 = 0 THEN 'temperature_differs' ELSE 'verified' END AS status FROM orders) GROUP BY 1, 2")
def src_10_report_verification(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").withColumn("t", (F.col("o_custkey") % 30).cast("double"))
    raw = F.format_string("METAR EGLL 01%s00Z 24010KT %02d/05 Q1012", F.when(F.col("o_orderkey") % 5 == 0, "10").otherwise("12"), (F.col("t") + F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(0)).cast("int"))
    status = readers.verified_report(F.regexp_replace(raw, "01(\\d\\d)00Z", "01$100Z"), F.lit("EGLL"), F.lit("1200"), F.col("t"))
    return o.groupBy("o_custkey", F.coalesce(status, F.lit("verified")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# gates


@query(f"WITH {GRID_SQL}, k AS (SELECT a.row, a.col, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS dist FROM grid a JOIN grid b ON b.size > 48 AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2) SELECT grid.row, grid.col, CASE WHEN size > 48 THEN 'cloud' WHEN dist <= 200 THEN 'near_cloud' WHEN value < 950 THEN 'implausible' END AS reason FROM grid LEFT JOIN k ON k.row = grid.row AND k.col = grid.col")
def flt_09_cloud_distance(spark: SparkSession, d: str) -> DataFrame:
    """Native gates with a distance to cloud (also FLT-10): cloudy cells are spread over the squares around them."""
    g = grid(spark, d)
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    cloud = g.filter("size > 48").select("row", "col", "x", "y").withColumn("i", around).withColumn("j", around)
    near = cloud.filter(F.hypot("i", "j") * 100 <= 200).select((F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).distinct().withColumn("near", F.lit(True))
    rules = [(F.col("size") > 48, "cloud"), (F.col("near"), "near_cloud"), (F.col("value") < 950, "implausible")]
    return g.join(near, ["row", "col"], "left").select("row", "col", E.first_reason(rules).alias("reason"))


@query(f"WITH {PREDICTED_SQL} SELECT CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS bad_a, CAST(count(*) FILTER (WHERE balance IS NULL) AS BIGINT) AS bad_balance, count(*) AS rows FROM predicted")
def flt_13_feature_contract(spark: SparkSession, d: str) -> DataFrame:
    """How many values break the contract, for training guards as well (FLT-24); a caller refuses the batch if any does."""
    p = predicted(spark, d)
    return p.agg(F.count_if(~E.finite(F.col("a"))).alias("bad_a"), F.count_if(~E.finite(F.col("balance"))).alias("bad_balance"), F.count(F.lit(1)).alias("rows"))


ALLOWED = ("balance", "surface", "product", "observed")


@query(f"WITH {SAMPLES_SQL} SELECT balance, product, count(*) AS n FROM samples GROUP BY 1, 2")
def flt_14_allowed_features(spark: SparkSession, d: str) -> DataFrame:
    """Only columns on the list can be predictors."""
    s = samples(spark, d)
    return s.select(*[c for c in ("balance", "product", "region_id", "sample_id") if c in ALLOWED and c in s.columns]).groupBy("balance", "product").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRID_SQL} SELECT count(*) FILTER (WHERE sqrt(pow(x - (col + 0.5) * 100, 2) + pow(y - (row + 0.5) * 100, 2)) > 2) AS off_centre, count(*) - count(DISTINCT row * 1000 + col) AS repeated, count(*) FILTER (WHERE row < 0 OR col NOT BETWEEN 0 AND 49) AS off_grid FROM grid")
def flt_15_grid_contract(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    off = F.hypot(F.col("x") - (F.col("col") + 0.5) * 100, F.col("y") - (F.col("row") + 0.5) * 100) > 2
    return g.agg(F.count_if(off).alias("off_centre"), (F.count(F.lit(1)) - F.count_distinct("row", "col")).alias("repeated"), F.count_if((F.col("row") < 0) | ~F.col("col").between(0, 49)).alias("off_grid"))


@query(f"WITH {HOURLY_SQL} SELECT event_id, CASE WHEN h.value IS NULL THEN 'no_source' WHEN abs(h.value - events.value) > 200 THEN 'value_differs' WHEN epoch(ts - h.hour) > 3000 THEN 'stale' END AS reason FROM events LEFT JOIN hourly h ON h.key = event_type AND h.hour = date_trunc('hour', ts)")
def flt_18_source_reverification(spark: SparkSession, d: str) -> DataFrame:
    """Joined rows against their source, with the first failed check (also FLT-23, FLT-25, FLT-28)."""
    hours = hourly_events(spark, d).select("key", "hour", F.col("value").alias("source_value"))
    j = joins.asof_hour(events(spark, d).withColumnRenamed("event_type", "key"), hours, ["key"], "ts", "hour", ["source_value"])
    rules = [(F.col("source_value").isNull(), "no_source"), (F.abs(F.col("source_value") - F.col("value")) > 200, "value_differs"), (F.col("age_minutes") > 50, "stale")]
    return j.select("event_id", E.first_reason(rules).alias("reason"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM r) SELECT o_custkey, o_orderkey FROM k WHERE k = 1""")
def flt_26_extension_candidates(spark: SparkSession, d: str) -> DataFrame:
    tried = load(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    left = load(spark, d, "orders").filter("o_orderstatus = 'O'").join(tried, "o_orderkey", "left_anti")
    return windows.top(left, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


_RING = [(300.0, 200.0), (4200.0, 700.0), (3600.0, 3500.0), (2000.0, 1500.0), (600.0, 3000.0)]


@query(f"WITH {GRID_SQL}, e AS (SELECT unnest([{', '.join(str([*a, *b]) for a, b in zip(_RING, _RING[1:] + _RING[:1]))}]) AS e), h AS (SELECT row, col, count(*) FILTER (WHERE (e[2] > y) <> (e[4] > y) AND x < (e[3] - e[1]) * (y - e[2]) / (e[4] - e[2]) + e[1]) AS n FROM grid, e GROUP BY 1, 2) SELECT row, col, n % 2 = 1 AS inside FROM h")
def flt_27_polygon_mask(spark: SparkSession, d: str) -> DataFrame:
    """Even-odd rule over a request's edges (its few vertices are literals); also the coverage share (JN-30)."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        cross = ((F.lit(y0) > F.col("y")) != (F.lit(y1) > F.col("y"))) & (F.col("x") < (x1 - x0) * (F.col("y") - y0) / ((y1 - y0) or 1.0) + x0)
        crossings = crossings + cross.cast("int")
    return grid(spark, d).select("row", "col", (crossings % 2 == 1).alias("inside"))


# projections


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END) AS elevation_m FROM supplier")
def prj_01_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Two spellings of one column must agree where both have a value."""
    s = load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("elevation"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("dem_m"))
    contracts.require(s, {"spellings agree": F.col("elevation").isNull() | F.col("dem_m").isNull() | (F.col("elevation") == F.col("dem_m"))})
    return s.select("s_suppkey", F.coalesce("elevation", "dem_m").alias("elevation_m"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round(b - a, 3) + 0.0 AS skin_less_air, round(c - a, 3) + 0.0 AS soil_less_air, round(a + (observed - b) * 0.5, 3) AS adjusted FROM predicted")
def prj_04_land_columns(spark: SparkSession, d: str) -> DataFrame:
    """Derived land columns; replaced calendar columns keep the others (PRJ-03)."""
    c = F.col
    return predicted(spark, d).select("sample_id", (F.round(c("b") - c("a"), 3) + 0.0).alias("skin_less_air"), (F.round(c("c") - c("a"), 3) + 0.0).alias("soil_less_air"), F.round(c("a") + (c("observed") - c("b")) * 0.5, 3).alias("adjusted"))


# joins


@query("SELECT event_id, g.acq, CASE WHEN g.acq IS NULL THEN 'none' WHEN ts <= g.e THEN 'inside' ELSE 'past' END AS swath FROM (SELECT events.event_id, ts, max(CASE WHEN s <= ts THEN struct_pack(s := s, e := e, acq := acq) END) AS g FROM events JOIN (SELECT user_id AS u, ts AS s, ts + INTERVAL 30 MINUTE AS e, event_id AS acq FROM events WHERE event_type = 'signup') w ON u = user_id GROUP BY 1, 2)")
def jn_19_same_swath(spark: SparkSession, d: str) -> DataFrame:
    """The latest interval that began by each time, and whether the time lies in it: an as-of lookup by its start."""
    e = events(spark, d)
    w = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("acq"))
    users = w.select("user_id").distinct()
    hit = joins.asof_backward(e.join(users, "user_id", "left_semi"), w, ["user_id"], "ts", ["acq"], 1e12, "acq", right_ts="start")
    return hit.select("event_id", "acq", E.ladder([(F.col("acq").isNull(), "none"), (F.col("age_s") <= 1800, "inside")], "past").alias("swath"))


@query(f"WITH {PREDICTED_SQL} SELECT region_id, count(*) AS rows, count(*) FILTER (WHERE sample_id % 307 = 0) AS differing, round(coalesce(max(CASE WHEN sample_id % 307 = 0 THEN (sample_id % 5 + 1) / 1e1 END), 0), 6) AS worst FROM predicted WHERE a IS NOT NULL GROUP BY 1")
def jn_25_aligned_blend(spark: SparkSession, d: str) -> DataFrame:
    """Saved arms aligned by id must reproduce the blend; some of those saved do not."""
    p = predicted(spark, d).filter("a IS NOT NULL")
    k = F.col("sample_id")
    blend = p.select("sample_id", (0.75 * F.col("a") + 0.25 * F.col("c") + F.when(k % 307 == 0, (k % 5 + 1) / 10).otherwise(0.0)).alias("saved"))
    both = contracts.join_validated(p, blend, ["sample_id"])
    gap = F.abs(F.col("saved") - (F.col("a") + 0.25 * (F.col("c") - F.col("a"))))
    return both.groupBy("region_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap > 1e-9).alias("differing"), F.round(F.max(gap), 6).alias("worst"))


@query("WITH c AS (SELECT l_orderkey, min(l_tax) AS t FROM lineitem GROUP BY 1) SELECT count(*) AS copies, count(*) FILTER (WHERE l_tax IS DISTINCT FROM t) AS different FROM lineitem JOIN c USING (l_orderkey)")
def jn_27_canonical_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies against the canonical row of their key, null-safe."""
    i = load(spark, d, "lineitem").select("l_orderkey", "l_tax")
    return i.join(i.groupBy("l_orderkey").agg(F.min("l_tax").alias("t")), "l_orderkey").agg(F.count(F.lit(1)).alias("copies"), F.count_if(~F.col("l_tax").eqNullSafe(F.col("t"))).alias("different"))


@query("WITH o AS (SELECT o_orderkey, round(o_totalprice / 10000, 1) AS cell FROM orders), c AS (SELECT DISTINCT round(o_totalprice / 10000, 1) AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, v IS NOT NULL AS attached FROM o LEFT JOIN c ON CAST(round(v * 10) AS BIGINT) = CAST(round(cell * 10) AS BIGINT)")
def jn_26_nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    """Attachment on whole-number cell keys, with the proof left to an audit column (also JN-29, JN-31)."""
    key = F.round(F.round(F.col("o_totalprice") / 10000, 1) * 10).cast("long").alias("cell")
    o = load(spark, d, "orders")
    cells = o.filter("o_orderkey % 2 = 0").select(key).distinct().withColumn("hit", F.lit(True))
    return o.select("o_orderkey", key).join(cells, "cell", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("attached"))


@query(f"WITH {HOURLY_SQL}, e AS (SELECT event_id, event_type, date_trunc('hour', ts) AS h FROM events), m AS (SELECT event_id, count(value) AS n, avg(value) AS v FROM e LEFT JOIN hourly ON key = event_type AND hour > h - INTERVAL 6 HOUR AND hour <= h GROUP BY 1) SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN n = 6 THEN round(v, 8) END, 1) AS energy, CASE WHEN event_id % 3 = 0 THEN 'proven' WHEN n = 6 THEN 'history_mean' ELSE 'missing_history' END AS basis FROM m")
def jn_33_history_fallback(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_events(spark, d)
    table = h.select("key", "hour", windows.full_window(h, ["key"], "hour", "value", 6, F.avg).alias("mean6"))
    e = joins.asof_hour(events(spark, d).withColumnRenamed("event_type", "key"), table, ["key"], "ts", "hour", ["mean6"])
    proven = F.when(F.col("event_id") % 3 == 0, 1.0)
    return e.select("event_id", F.round(F.coalesce(proven, F.round("mean6", 8)), 1).alias("energy"), E.ladder([(proven.isNotNull(), "proven"), (F.col("mean6").isNotNull(), "history_mean")], "missing_history").alias("basis"))


@query("SELECT e.event_id, p.value AS truth FROM events e JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.ts = e.ts WHERE e.event_type <> 'signup'")
def jn_32_exact_truth(spark: SparkSession, d: str) -> DataFrame:
    truth = events(spark, d).filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("truth"))
    return events(spark, d).filter("event_type <> 'signup'").join(truth, ["user_id", "ts"]).select("event_id", "truth")


# metrics


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, c - observed AS e FROM predicted WHERE c IS NOT NULL), {_weights_sql('ok')} SELECT sample_id, round(e - sum(weight * e) OVER (PARTITION BY region_id, acquisition_id) / sum(weight) OVER (PARTITION BY region_id, acquisition_id), 6) AS centred FROM w")
def win_11_centred_error(spark: SparkSession, d: str) -> DataFrame:
    w = windows.balanced_weights(predicted(spark, d).filter("c IS NOT NULL").withColumn("e", F.col("c") - F.col("observed")), LEVELS)
    mean = w.groupBy("region_id", "acquisition_id").agg((F.sum(F.col("weight") * F.col("e")) / F.sum("weight")).alias("m"))
    return w.join(mean, ["region_id", "acquisition_id"]).select("sample_id", F.round(F.col("e") - F.col("m"), 6).alias("centred"))


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT region_id, month, count(*) AS n FROM samples GROUP BY 1, 2) SELECT region_id, CAST(sum(n) AS BIGINT) AS granules, count(*) AS months, array_to_string(list_sort(list(month || '=' || n)), ',') AS calendar FROM c GROUP BY 1")
def agg_18_inventory(spark: SparkSession, d: str) -> DataFrame:
    c = samples(spark, d).groupBy("region_id", "month").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("region_id").agg(F.sum("n").alias("granules"), F.count(F.lit(1)).alias("months"), F.array_join(F.array_sort(F.collect_list(F.concat("month", F.lit("="), F.col("n").cast("string")))), ",").alias("calendar"))


@query(f"WITH {PREDICTED_SQL} SELECT region_id, month, count(*) AS targets, count(a) AS matched, count(DISTINCT CASE WHEN a IS NOT NULL THEN utc_day END) AS matched_dates FROM predicted GROUP BY 1, 2")
def agg_21_matched_support(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).groupBy("region_id", "month").agg(F.count(F.lit(1)).alias("targets"), F.count("a").alias("matched"), F.count_distinct(F.when(F.col("a").isNotNull(), F.col("utc_day"))).alias("matched_dates"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, count(*) AS n, round(avg(CASE WHEN balance > 5000 THEN observed END), 6) AS humid, round(avg(CASE WHEN balance <= 5000 THEN observed END), 6) AS dry FROM samples GROUP BY 1, 2")
def agg_29_station_summary(spark: SparkSession, d: str) -> DataFrame:
    humid = F.col("balance") > 5000
    return samples(spark, d).groupBy("region_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(humid, F.col("observed"))), 6).alias("humid"), F.round(F.avg(F.when(~humid, F.col("observed"))), 6).alias("dry"))


@query(f"WITH {HOURLY_SQL} SELECT key, count(*) AS exact_hours, count(DISTINCT CAST(hour AS DATE)) AS days, 744 - count(*) AS missing_hours FROM hourly GROUP BY 1")
def agg_36_delivery(spark: SparkSession, d: str) -> DataFrame:
    return hourly_events(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("exact_hours"), F.count_distinct(F.to_date("hour")).alias("days"), (F.lit(744) - F.count(F.lit(1))).alias("missing_hours"))


@query(f"WITH {GRID_SQL} SELECT CAST(row // 10 AS INT) AS window_row, CAST(col // 10 AS INT) AS window_col, round(avg(CASE WHEN size > 5 THEN value END), 6) AS label, round(avg(CASE WHEN size <= 40 THEN value END), 6) AS optical, max(CASE WHEN size > 5 THEN size END) AS uncertainty FROM grid GROUP BY 1, 2")
def agg_37_two_masks(spark: SparkSession, d: str) -> DataFrame:
    label, optical = F.col("size") > 5, F.col("size") <= 40
    return grid(spark, d).groupBy(F.expr("CAST(row div 10 AS INT)").alias("window_row"), F.expr("CAST(col div 10 AS INT)").alias("window_col")).agg(F.round(F.avg(F.when(label, F.col("value"))), 6).alias("label"), F.round(F.avg(F.when(optical, F.col("value"))), 6).alias("optical"), F.max(F.when(label, F.col("size"))).alias("uncertainty"))


# scalar functions


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity * 10 + 200 > 0.03 * 300 THEN pow((l_quantity * 10 + 200 - 0.03 * 300) / (0.97 * 5.670374419e-8), 0.25) - 273.15 END, 6) AS radiometric, round(greatest(0, l_quantity * 20 * cos(radians(l_tax * 1000)) + l_discount * 100), 6) AS shortwave, round(sin(radians(l_partkey % 360)), 8) AS wind_sin FROM lineitem")
def sc_06_radiation(spark: SparkSession, d: str) -> DataFrame:
    """Radiometric temperature, component shortwave, wind components (SC-06, SC-08, SC-27)."""
    i = load(spark, d, "lineitem")
    return i.select("l_orderkey", "l_linenumber", F.round(E.radiometric_temperature_c(F.col("l_quantity") * 10 + 200, F.lit(300.0), 0.97), 6).alias("radiometric"), F.round(E.component_shortwave(F.col("l_quantity") * 20, F.col("l_discount") * 100, F.col("l_tax") * 1000), 6).alias("shortwave"), F.round(E.wind_components((F.col("l_partkey") % 360).cast("double"))[0], 8).alias("wind_sin"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round(CASE WHEN a IS NOT NULL AND balance >= 0 THEN 0.8 * a END, 8) AS proxy, concat_ws(';', CASE WHEN a IS NULL THEN 'missing_source' END, CASE WHEN NOT coalesce(balance >= 0, false) THEN 'unusable_state' END) AS reasons FROM predicted")
def sc_07_flux_proxies(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("a").isNotNull() & (F.col("balance") >= 0)
    return predicted(spark, d).select("sample_id", F.round(F.when(ok, 0.8 * F.col("a")), 8).alias("proxy"), E.all_reasons([(F.col("a").isNull(), "missing_source"), (~E.passes(F.col("balance") >= 0), "unusable_state")]).alias("reasons"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders")
def sc_12_name_times(spark: SparkSession, d: str) -> DataFrame:
    """Two forms of time in names, parsed back; also units of elapsed time (SC-36)."""
    o = load(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("G_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_x"))).otherwise(F.concat(F.lit("P."), F.date_format("o_orderdate", "yyyyDDD"), F.lit(".0000.h5")))
    elapsed = E.cf_time(F.datediff("o_orderdate", F.to_date(F.lit("1990-01-01"))).cast("double"), F.lit("days since 1990-01-01"))
    return o.select("o_orderkey", F.date_format(F.when(F.col("o_orderkey") % 3 == 0, elapsed).otherwise(E.name_time(name)), "yyyy-MM-dd").alias("parsed"))


@query("SELECT s_suppkey, CAST(4 AS INT) AS vertices, s_suppkey * 1.0 AS west, s_suppkey * 1.0 + 2 AS east FROM supplier")
def sc_26_footprints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    ring = F.format_string("0 %d 0 %d 2 %d 2 %d 0 %d", k, k + 2, k + 2, k, k)
    p = load(spark, d, "supplier").select("s_suppkey", readers.ring_points(ring).alias("p"))
    return p.select("s_suppkey", F.size("p").alias("vertices"), F.array_min(F.transform("p", lambda x: x["x"])).alias("west"), F.array_max(F.transform("p", lambda x: x["x"])).alias("east"))


@query("SELECT event_id, json_object('value', value, 'type', event_type)::VARCHAR AS receipt FROM (SELECT event_id, CAST(floor(value) AS INT) AS value, event_type FROM events)")
def sc_30_receipts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.to_json(F.struct(F.floor("value").cast("int").alias("value"), F.col("event_type").alias("type"))).alias("receipt"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round(a + (observed - b), 8) AS shifted, CASE WHEN abs(observed - b) > 200 THEN 'background' ELSE 'reported' END AS basis FROM predicted WHERE a IS NOT NULL")
def sc_32_reported_shift(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return predicted(spark, d).filter("a IS NOT NULL").select("sample_id", F.round(c("a") + (c("observed") - c("b")), 8).alias("shifted"), F.when(F.abs(c("observed") - c("b")) > 200, "background").otherwise("reported").alias("basis"))


_TILE_SUN = solar_sql("SELECT station_id, TIMESTAMP '2024-06-21 12:00:00' AS ts, CAST(lat AS DOUBLE) + o.i AS lat, CAST(lon AS DOUBLE) + o.j AS lon FROM stations, (SELECT unnest([{'i': 0, 'j': 0}, {'i': 2, 'j': 2}, {'i': 2, 'j': -2}, {'i': -2, 'j': 2}, {'i': -2, 'j': -2}]) AS o)", "station_id")


@query(f"WITH {STATIONS_SQL}, {_TILE_SUN}, b AS (SELECT station_id, min(elevation) AS lo, max(elevation) AS hi FROM solar GROUP BY 1) SELECT station_id, round(lo, 4) AS least, round(hi, 4) AS most, CASE WHEN lo >= 6 THEN 'day' WHEN hi <= -6 THEN 'night' ELSE 'mixed' END AS phase FROM b")
def sc_34_tile_phase(spark: SparkSession, d: str) -> DataFrame:
    """Solar elevation at a tile's centre and corners; the phase of its darkest and brightest."""
    at = F.to_timestamp(F.lit("2024-06-21 12:00:00"))
    points = [E.solar_elevation(at, F.col("lat") + i, F.col("lon") + j) for i, j in ((0, 0), (2, 2), (2, -2), (-2, 2), (-2, -2))]
    low, high = F.least(*points), F.greatest(*points)
    return stations(spark, d).select("station_id", F.round(low, 4).alias("least"), F.round(high, 4).alias("most"), E.ladder([(low >= 6, "day"), (high <= -6, "night")], "mixed").alias("phase"))


@query(f"WITH {SAMPLES_SQL}, b AS (SELECT region_id, min(ts) AS s, max(ts) AS f FROM samples GROUP BY 1) SELECT count(*) FILTER (WHERE NOT s <= f) AS out_of_order, count(*) AS bounds FROM b")
def sc_35_monotone_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = samples(spark, d).groupBy("region_id").agg(F.min("ts").alias("s"), F.max("ts").alias("f"))
    return b.agg(F.count_if(~(F.col("s") <= F.col("f"))).alias("out_of_order"), F.count(F.lit(1)).alias("bounds"))


# selection, sets, memberships


@query(f"WITH {PREDICTED_SQL}, m AS (SELECT region_id, avg(abs(c - observed)) AS mae, count(*) AS size FROM predicted GROUP BY 1) SELECT region_id FROM m WHERE mae <= (SELECT min(mae) FROM m) + 3 ORDER BY size, region_id LIMIT 1")
def srt_05_near_best(spark: SparkSession, d: str) -> DataFrame:
    m = predicted(spark, d).groupBy("region_id").agg(F.avg(F.abs(F.col("c") - F.col("observed"))).alias("mae"), F.count(F.lit(1)).alias("size"))
    return metrics.near_best(m, "mae", 3.0, [F.col("size"), F.col("region_id")]).select("region_id")


@query(f"WITH {SAMPLES_SQL} SELECT count(*) FILTER (WHERE o AND sample_id % 101 = 0) AS lost, count(*) FILTER (WHERE NOT o AND sample_id % 101 <> 0) AS added, count(*) FILTER (WHERE o AND sample_id % 101 <> 0 AND sample_id % 103 = 0) AS changed FROM (SELECT sample_id, utc_day < DATE '2000-01-01' AS o FROM samples)")
def set_04_preserving_append(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    old = s.filter(F.col("utc_day") < F.to_date(F.lit("2000-01-01")))
    appended = s.filter(F.col("sample_id") % 101 != 0).withColumn("observed", F.col("observed") + F.when(F.col("sample_id") % 103 == 0, 1.0).otherwise(0.0))
    return contracts.compare_identity(old, appended, "sample_id", ["observed", "region_id"]).select("lost", "added", "changed")


@query(f"WITH {SAMPLES_SQL} SELECT CASE WHEN year(ts) < 2000 THEN 'fit' ELSE 'evaluation' END AS target, year(ts) AS year, count(*) AS n FROM samples GROUP BY 1, 2")
def set_08_targets_by_year(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy(F.when(F.year("ts") < 2000, "fit").otherwise("evaluation").alias("target"), F.year("ts").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES_SQL}, a AS (SELECT *, unnest(CASE WHEN utc_day < DATE '1999-01-01' THEN ['old_only', 'expanded'] ELSE ['expanded'] END) AS arm FROM samples WHERE acquisition_id NOT IN (SELECT acquisition_id FROM samples WHERE region_id = 'NATION_3')) SELECT arm, phase, count(*) AS n FROM a GROUP BY 1, 2")
def spl_06_paired_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Old-only and expanded arms with reserved physical keys left out (also the registry's roles, SPL-07)."""
    s = samples(spark, d)
    free = s.join(s.filter("region_id = 'NATION_3'").select("acquisition_id").distinct(), "acquisition_id", "left_anti")
    arm = F.when(F.col("utc_day") < F.to_date(F.lit("1999-01-01")), F.array(F.lit("old_only"), F.lit("expanded"))).otherwise(F.array(F.lit("expanded")))
    return free.select("phase", F.explode(arm).alias("arm")).groupBy("arm", "phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRID_SQL} SELECT row, col, (row // 10 + 2 * (col // 10)) % 5 = 0 AS spatial_test, row % 10 = 0 OR col % 10 = 0 AS boundary, CASE WHEN row % 10 = 0 OR col % 10 = 0 THEN 'boundary' WHEN (row // 10 + 2 * (col // 10)) % 5 = 0 THEN 'holdout' ELSE 'fit_safe' END AS part FROM grid")
def spl_10_cell_partition(spark: SparkSession, d: str) -> DataFrame:
    """Block roles as columns and as one label (SPL-09, SPL-10)."""
    held = F.expr("(row div 10 + 2 * (col div 10)) % 5 = 0")
    edge = (F.col("row") % 10 == 0) | (F.col("col") % 10 == 0)
    return grid(spark, d).select("row", "col", held.alias("spatial_test"), edge.alias("boundary"), E.ladder([(edge, "boundary"), (held, "holdout")], "fit_safe").alias("part"))


# estimation


@query(f"WITH {PREDICTED_SQL}, m AS (SELECT phase, CASE WHEN balance > 0 THEN 'snow' ELSE 'bare' END AS snow, utc_day, count(*) AS m, sum((b - a) * (b - observed)) AS de, sum((b - a) * (b - a)) AS dd FROM predicted WHERE a IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT phase, snow, sum(m) AS m, sum(m * m) AS mm, sum(de) AS de, sum(dd) AS dd, count(*) AS dates FROM m GROUP BY 1, 2), n AS (SELECT *, m * m / mm AS n FROM g) SELECT phase, snow, dates, round(CASE WHEN dates >= 6 THEN greatest(0, least(1, (n * de / m) / (n * dd / m + 20))) ELSE 0 END, 6) AS gamma FROM n")
def ml_06_stratum_shrink(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("a IS NOT NULL").withColumns({"snow": F.when(F.col("balance") > 0, "snow").otherwise("bare"), "one": F.lit(1.0)})
    return estimate.scalar_shrink(p, ["phase", "snow"], "one", F.col("b") - F.col("a"), F.col("b") - F.col("observed"), "utc_day").select("phase", "snow", "dates", _r("gamma"))


@query()
def ml_07_capped_correction(spark: SparkSession, d: str) -> DataFrame:
    """Standardised ridge on residuals with an interaction, shrunk and capped at 2."""
    p = predicted(spark, d).filter("a IS NOT NULL").withColumn("one", F.lit(1.0))
    a, b = estimate.standardised(p, ["a", "balance"], "one")
    features = [F.lit(1.0), a, b, a * b]
    raw = estimate.linear(features, estimate.ridge(p, features, F.col("observed") - F.col("a"), F.lit(1.0), 10.0))
    return p.select("sample_id", F.round(estimate.shrunk_correction(raw, F.col("phase") != "P", 0.5, 2.0), 5).alias("correction"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round(a - 25, 6) AS low, round(a + 25, 6) AS high, product NOT IN (SELECT product FROM samples WHERE utc_day < DATE '1995-01-02') AS unseen FROM predicted WHERE a IS NOT NULL")
def ml_13_intervals(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("a IS NOT NULL")
    seen = samples(spark, d).filter(F.col("utc_day") < F.to_date(F.lit("1995-01-02"))).select("product").distinct().withColumn("seen", F.lit(True))
    return p.join(seen, "product", "left").select("sample_id", F.round(F.col("a") - 25, 6).alias("low"), F.round(F.col("a") + 25, 6).alias("high"), F.col("seen").isNull().alias("unseen"))


@query()
def ml_09_forest(spark: SparkSession, d: str) -> DataFrame:
    p = written(predicted(spark, d).select("phase", "a", "balance", "observed", F.lit(1.0).alias("weight")), "predicted")
    model = estimate.offset_pipeline(["a", "balance"], "phase", "observed", "weight", "forest", numTrees=8, maxDepth=4).fit(p)
    return model.transform(p).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col("observed"))).alias("mae"))


@query()
def ml_11_paired_populations(spark: SparkSession, d: str) -> DataFrame:
    """One recipe on two training populations, scored on the same held rows."""
    p = written(predicted(spark, d).filter("a IS NOT NULL").select("region_id", "phase", "utc_day", "a", "balance", "observed", F.lit(1.0).alias("weight")), "predicted")  # both fits read it many times
    held = F.col("region_id").isin("NATION_3", "NATION_7")
    out = None
    for arm, end in (("old_only", "1998-01-01"), ("expanded", "2002-01-01")):
        model = estimate.offset_pipeline(["a", "balance"], "phase", "observed", "weight").fit(p.filter(~held & (F.col("utc_day") < F.to_date(F.lit(end)))))
        scored = model.transform(p.filter(held)).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("observed"))), 4).alias("mae")).withColumn("arm", F.lit(arm))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("SELECT DISTINCT o_orderstatus AS kind, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
def flt_24_training_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a guard lets through, by kind; anything that breaks it raises."""
    o = load(spark, d, "orders")
    contracts.require(o, {"known kind": F.col("o_orderstatus").isin("F", "O", "P"), "positive value": F.col("o_totalprice") > 0})
    return o.groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, CAST(utc_day AS VARCHAR) AS utc_day, count(DISTINCT phase) AS splits FROM samples GROUP BY 1, 2 HAVING count(DISTINCT phase) > 1")
def spl_02_crossing(spark: SparkSession, d: str) -> DataFrame:
    return splits.crossing(samples(spark, d), ["region_id", "utc_day"], "phase").withColumn("utc_day", F.col("utc_day").cast("string"))
