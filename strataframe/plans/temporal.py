"""Joins in time, history windows, ranks and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ceil_hour, floor_hour
from ..operators import contracts, joins, windows
from ..session import load
from .registry import query
from .views import HOURLY_SQL, SAMPLES_SQL, hourly_events, samples

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(*EVENT_COLUMNS)


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


_PRIOR = "DATE_TRUNC('hour', ts) - INTERVAL 1 HOUR"


@query(f"WITH {HOURLY_SQL} SELECT event_id, round(h.value, 6) AS background, round(epoch(ts - h.hour) / 60, 4) AS age_minutes FROM events LEFT JOIN hourly h ON h.key = event_type AND h.hour = date_trunc('hour', ts)")
def jn_01_asof_hour(spark: SparkSession, d: str) -> DataFrame:
    hours = hourly_events(spark, d).select("key", "hour", F.col("value").alias("background"))
    left = events(spark, d).withColumnRenamed("event_type", "key")
    return joins.asof_hour(left, hours, ["key"], "ts", "hour", ["background"]).select("event_id", _r("background"), _r("age_minutes", 4))


_ASOF_SQL = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS rts, value AS reported, event_id AS rid FROM events WHERE event_type = 'view'),
m AS (SELECT l.event_id, reported, rts, row_number() OVER (PARTITION BY l.event_id ORDER BY rts DESC, rid DESC) AS k, epoch(l.ts - rts) AS age FROM l JOIN r ON l.user_id = r.user_id AND rts <= l.ts)
SELECT l.event_id, CASE WHEN age <= 86400 THEN reported END AS reported, round(CASE WHEN age <= 86400 THEN age END, 3) AS age_s FROM l LEFT JOIN m ON m.event_id = l.event_id AND k = 1"""


def _asof(spark: SparkSession, d: str, salt: float | None) -> DataFrame:
    e = events(spark, d)
    reports = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("reported"), F.col("event_id").alias("report_id"))
    return joins.asof_backward(e.filter("event_type = 'purchase'"), reports, ["user_id"], "ts", ["reported"], 86400, "report_id", span_s=salt).select("event_id", "reported", _r("age_s", 3))


@query(_ASOF_SQL)
def jn_02_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, None)


@query(_ASOF_SQL)
def jn_02_asof_backward_spans(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, 2 * 86400.0)


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 50 AS place, o_totalprice AS x FROM orders), c AS (SELECT s_suppkey, s_suppkey % 50 AS place, s_acctbal * 30 AS x, CAST(s_suppkey // 50 AS BIGINT) AS rank FROM supplier),
k AS (SELECT o_orderkey, s_suppkey, abs(o.x - c.x) AS dist, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o.x - c.x), rank) AS k FROM o JOIN c USING (place) WHERE abs(o.x - c.x) <= 40000)
SELECT o.o_orderkey, s_suppkey AS station, round(dist, 6) AS candidate_distance FROM o LEFT JOIN k ON k.o_orderkey = o.o_orderkey AND k = 1""")
def jn_03_nearest_candidate(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("place"), F.col("o_totalprice").alias("x"))
    c = load(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") % 50).alias("place"), (F.col("s_acctbal") * 30).alias("sx"), F.expr("s_suppkey div 50").alias("rank"))
    return joins.nearest_on_line(o, c, ["place"], "o_orderkey", "x", "sx", 40000, "rank", ["station"]).select("o_orderkey", "station", _r("candidate_distance"))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS rts, value AS obs, event_id AS rid FROM events WHERE event_type = 'view'),
m AS (SELECT l.event_id, l.ts, obs, rts, row_number() OVER (PARTITION BY l.event_id ORDER BY rts DESC, rid DESC) AS k FROM l JOIN r ON l.user_id = r.user_id AND rts <= l.ts)
SELECT m.event_id, round(CASE WHEN abs(obs - b.value) <= 20 AND epoch(m.ts - rts) / 60 <= 1440 THEN p.value + (obs - b.value) END, 6) AS air FROM m
LEFT JOIN hourly p ON p.key = 'purchase' AND p.hour = date_trunc('hour', m.ts) LEFT JOIN hourly b ON b.key = 'purchase' AND b.hour = date_trunc('hour', rts) WHERE k = 1 AND epoch(m.ts - rts) <= 86400""")
def jn_04_residual_corrected(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    reports = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("reported"), F.col("event_id").alias("report_id"))
    hit = joins.asof_backward(e.filter("event_type = 'purchase'"), reports, ["user_id"], "ts", ["reported"], 86400, "report_id").filter("matched_ts IS NOT NULL")
    hours = hourly_events(spark, d).filter("key = 'purchase'")
    here, there = (hours.select(F.col("hour").alias(f"{n}_hour"), F.col("value").alias(n)) for n in ("here", "there"))
    both = hit.join(here, floor_hour(F.col("ts")) == F.col("here_hour"), "left").join(there, floor_hour(F.col("matched_ts")) == F.col("there_hour"), "left")
    air = joins.residual_corrected(F.col("here"), F.col("reported"), F.col("there"), F.lit(0.0), F.col("age_s") / 60, most_age=1440)
    return both.select("event_id", F.round(air, 6).alias("air"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND s_acctbal > o_totalprice / 40 THEN s_acctbal ELSE o_totalprice END AS o_totalprice, coalesce(o_orderstatus = 'F' AND s_acctbal > o_totalprice / 40, false) AS replaced FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey")
def jn_05_conditional_update(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_acctbal").alias("new_o_totalprice"))
    return joins.update_where(o, s, "o_orderkey", (F.col("o_orderstatus") == "F") & (F.col("new_o_totalprice") > F.col("o_totalprice") / 40), ["o_totalprice"]).select("o_orderkey", "o_totalprice", "replaced")


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn_06_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return contracts.join_validated(load(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_acctbal")


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS left_only, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS right_only, (SELECT count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)) AS shared")
def jn_07_same_key_sets(spark: SparkSession, d: str) -> DataFrame:
    return contracts.same_sets(load(spark, d, "orders").select(F.col("o_orderkey").alias("k")), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query(f"""WITH {HOURLY_SQL}, e AS (SELECT event_id, event_type, ts, epoch(ts - date_trunc('hour', ts)) / 3600 AS alpha FROM events)
SELECT event_id, round(CASE WHEN alpha > 0 THEN lo.value + alpha * (hi.value - lo.value) ELSE lo.value END, 3) AS interpolated FROM e LEFT JOIN hourly lo ON lo.key = event_type AND lo.hour = date_trunc('hour', ts)
LEFT JOIN hourly hi ON hi.key = event_type AND hi.hour = CASE WHEN alpha > 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE ts END""")
def jn_08_bracket_interpolate(spark: SparkSession, d: str) -> DataFrame:
    left = events(spark, d).select("event_id", "ts", F.col("event_type").alias("key"))
    return joins.bracket_interpolate(left, hourly_events(spark, d), ["key"], "ts", "hour", "value", "interpolated").select("event_id", _r("interpolated", 3))


@query(f"WITH {SAMPLES_SQL} SELECT count(*) AS overlap FROM samples WHERE utc_day < DATE '1996-01-01' AND acquisition_id IN (SELECT acquisition_id FROM samples WHERE utc_day >= DATE '2001-01-01')")
def jn_11_semi_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    return s.filter(F.col("utc_day") < F.to_date(F.lit("1996-01-01"))).join(s.filter(F.col("utc_day") >= F.to_date(F.lit("2001-01-01"))).select("acquisition_id").distinct(), "acquisition_id", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id FROM samples WHERE utc_day >= DATE '2001-01-01' AND NOT EXISTS (SELECT 1 FROM samples o WHERE o.utc_day < DATE '2001-01-01' AND o.acquisition_id = samples.acquisition_id)")
def jn_11_anti_fresh(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    late = F.col("utc_day") >= F.to_date(F.lit("2001-01-01"))
    return s.filter(late).join(s.filter(~late).select("acquisition_id").distinct(), "acquisition_id", "left_anti").select("sample_id")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS build, l_suppkey AS rev, l_partkey % 7 AS f FROM lineitem), t AS (SELECT l_orderkey, max(struct_pack(a := build, b := rev)) AS t FROM i GROUP BY 1)
SELECT i.l_orderkey, CASE WHEN count(DISTINCT f) = 1 THEN min(f) END AS selected, CASE WHEN count(DISTINCT f) = 1 THEN 'selected' ELSE 'unknown_conflicting_revisions' END AS status FROM i JOIN t ON i.l_orderkey = t.l_orderkey AND build = t.t.a AND rev = t.t.b GROUP BY 1""")
def jn_15_latest_revision(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("build"), F.col("l_suppkey").alias("rev"), (F.col("l_partkey") % 7).alias("f"))
    return joins.latest_revision(i, ["l_orderkey"], ["build", "rev"], "f").select("l_orderkey", "selected", "status")


_JOBS_SQL = "jobs AS (SELECT c_custkey AS acquisition_id, c_custkey AS job_id, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 900 AS INT)) AS s, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 900 + 700 AS INT)) AS e FROM customer)"


@query(f"WITH {SAMPLES_SQL}, {_JOBS_SQL} SELECT sample_id, count(job_id) AS owners, min(job_id) AS job_id FROM samples LEFT JOIN jobs ON samples.acquisition_id = jobs.acquisition_id AND ts >= s AND ts < e GROUP BY sample_id")
def jn_17_unique_owner(spark: SparkSession, d: str) -> DataFrame:
    base = F.to_timestamp(F.lit("1995-01-01"))
    jobs = load(spark, d, "customer").select(F.col("c_custkey").alias("acquisition_id"), F.col("c_custkey").alias("job_id"), (base + F.make_dt_interval((F.col("c_custkey") % 900).cast("int"))).alias("start_ts"), (base + F.make_dt_interval((F.col("c_custkey") % 900 + 700).cast("int"))).alias("end_ts"))
    return joins.unique_owner(samples(spark, d).select("sample_id", "acquisition_id", "ts"), jobs, ["acquisition_id"], "ts").select("sample_id", "owners", "job_id")


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT sample_id, acquisition_id, row_number() OVER (PARTITION BY acquisition_id ORDER BY ts DESC, sample_id DESC) AS k FROM samples WHERE ts < TIMESTAMP '2000-01-01') SELECT acquisition_id, sample_id, CAST(k AS INT) AS place FROM k WHERE k <= 3")
def win_03_latest_k(spark: SparkSession, d: str) -> DataFrame:
    past = samples(spark, d).filter(F.col("ts") < F.to_timestamp(F.lit("2000-01-01")))
    return windows.top(past, ["acquisition_id"], [F.desc("ts"), F.desc("sample_id")], 3, "place").select("acquisition_id", "sample_id", "place")


@query(f"WITH {SAMPLES_SQL}, l AS (SELECT sample_id, region_id, phase, row_number() OVER (PARTITION BY region_id, phase ORDER BY balance DESC, surface, sample_id) AS k FROM samples) SELECT region_id, phase, sample_id, CAST(k AS INT) AS place FROM l WHERE k <= 5")
def win_04_top_k(spark: SparkSession, d: str) -> DataFrame:
    return windows.top(samples(spark, d), ["region_id", "phase"], [F.desc("balance"), F.col("surface"), F.col("sample_id")], 5, "place").select("region_id", "phase", "sample_id", "place")


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT sample_id, region_id, month, row_number() OVER (PARTITION BY region_id, month ORDER BY sha256('7:' || sample_id), sample_id) AS k FROM samples) SELECT sample_id, region_id, month, CAST(k AS INT) AS place FROM k WHERE k <= 2")
def win_05_hash_rank(spark: SparkSession, d: str) -> DataFrame:
    return windows.hash_sample(samples(spark, d), ["region_id", "month"], "sample_id", 7, 2, "place").select("sample_id", "region_id", "month", "place")


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT sample_id, sha256('2708:' || sample_id) AS h, row_number() OVER (PARTITION BY region_id, phase, utc_day ORDER BY sha256('2708:' || sample_id), sample_id) AS k FROM samples) SELECT sample_id FROM k ORDER BY k, h, sample_id LIMIT 2000")
def win_06_round_robin_cap(spark: SparkSession, d: str) -> DataFrame:
    return windows.round_robin_cap(samples(spark, d), ["region_id", "phase", "utc_day"], "sample_id", 2708, 2000).select("sample_id")


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, row_number() OVER (PARTITION BY region_id ORDER BY ts, sample_id) AS turn, region_id FROM samples")
def win_07_turns(spark: SparkSession, d: str) -> DataFrame:
    return windows.turns(samples(spark, d), ["region_id"], [F.col("ts"), F.col("sample_id")], span=F.to_date("ts")).select("sample_id", F.col("turn").cast("long").alias("turn"), "region_id")


@query(f"WITH {HOURLY_SQL} SELECT a.key, strftime(a.hour, '%Y-%m-%d %H') AS hour, b.value AS lag_1, c.value AS lag_24 FROM hourly a LEFT JOIN hourly b ON b.key = a.key AND b.hour = a.hour - INTERVAL 1 HOUR LEFT JOIN hourly c ON c.key = a.key AND c.hour = a.hour - INTERVAL 24 HOUR")
def win_08_lags(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_events(spark, d)
    return h.select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), windows.lagged(h, ["key"], "hour", "value", 1).alias("lag_1"), windows.lagged(h, ["key"], "hour", "value", 24).alias("lag_24"))


_RANGE = "OVER (PARTITION BY key ORDER BY hour RANGE BETWEEN INTERVAL {0} HOUR PRECEDING AND CURRENT ROW)"


def _win_sql(value: str, hours: int, function: str = "sum") -> str:
    over = _RANGE.format(hours - 1)
    return f"CASE WHEN count({value}) {over} = {hours} THEN {function}({value}) {over} END"


@query(f"WITH {HOURLY_SQL} SELECT key, strftime(hour, '%Y-%m-%d %H') AS hour, round({_win_sql('value', 3)}, 9) AS sum_3h, round({_win_sql('value', 24, 'avg')}, 9) AS mean_24h, round({_win_sql('value', 72, 'avg')}, 9) AS mean_72h FROM hourly")
def win_09_full_windows(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_events(spark, d)
    w = lambda n, f=F.sum: F.round(windows.full_window(h, ["key"], "hour", "value", n, f), 9)
    return h.select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), w(3).alias("sum_3h"), w(24, F.avg).alias("mean_24h"), w(72, F.avg).alias("mean_72h"))


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, value - 30 AS sw, value - 10 AS lw, value AS air FROM hourly), x AS (SELECT *, CASE WHEN sw >= 0 THEN sw END AS s1, CASE WHEN lw > 0 THEN lw END AS l1 FROM s)
SELECT x.key, strftime(x.hour, '%Y-%m-%d %H') AS hour, count(x.s1) OVER (PARTITION BY x.key ORDER BY x.hour RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) AS shortwave_6h_valid_hours, round(3600 * {_win_sql('s1', 6).replace('key', 'x.key').replace('hour', 'x.hour')}, 3) AS shortwave_energy_6h_j_m2,
 round({_win_sql('l1', 6, 'avg').replace('key', 'x.key').replace('hour', 'x.hour')}, 9) AS longwave_mean_6h_w_m2, round({_win_sql('air', 24, 'avg').replace('key', 'x.key').replace('hour', 'x.hour')}, 9) AS air_mean_24h_c, round(x.air - p.value, 9) AS air_change_3h_c
 FROM x LEFT JOIN hourly p ON p.key = x.key AND p.hour = x.hour - INTERVAL 3 HOUR""")
def win_10_thermal_memory(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_events(spark, d).withColumns({"sw": F.col("value") - 30, "lw": F.col("value") - 10, "air": F.col("value")})
    m = windows.thermal_memory(h, ["key"], "hour", "sw", "lw", "air")
    return m.select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "shortwave_6h_valid_hours", _r("shortwave_energy_6h_j_m2", 3), _r("longwave_mean_6h_w_m2", 9), _r("air_mean_24h_c", 9), _r("air_change_3h_c", 9))


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY acquisition_id, month ORDER BY ts DESC, sample_id DESC) AS k FROM samples) SELECT acquisition_id, month, sample_id FROM k WHERE k = 1")
def win_12_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return windows.top(samples(spark, d), ["acquisition_id", "month"], [F.desc("ts"), F.desc("sample_id")]).select("acquisition_id", "month", "sample_id")


@query(f"WITH {SAMPLES_SQL}, t AS (SELECT region_id, surface, count(*) AS n FROM samples GROUP BY 1, 2), b AS (SELECT region_id, surface, row_number() OVER (PARTITION BY region_id ORDER BY n DESC, surface) AS k FROM t), j AS (SELECT sample_id, samples.region_id, row_number() OVER (PARTITION BY samples.region_id ORDER BY sha256('3:' || sample_id), sample_id) AS k FROM samples JOIN b ON b.region_id = samples.region_id AND b.surface = samples.surface AND b.k = 1) SELECT region_id, sample_id FROM j WHERE k <= 10")
def win_14_best_tile_sample(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    best = windows.top(s.groupBy("region_id", "surface").agg(F.count(F.lit(1)).alias("n")), ["region_id"], [F.desc("n"), F.col("surface")]).select("region_id", "surface")
    return windows.hash_sample(s.join(best, ["region_id", "surface"]), ["region_id"], "sample_id", 3, 10).select("region_id", "sample_id")


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, dense_rank() OVER (ORDER BY region_id, phase) AS group_number FROM samples")
def win_15_group_number(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    from pyspark.sql import Window

    groups = s.select("region_id", "phase").distinct().withColumn("group_number", F.row_number().over(Window.orderBy("region_id", "phase")).cast("long"))
    return s.join(groups, ["region_id", "phase"]).select("sample_id", "group_number")


@query(f"WITH {HOURLY_SQL}, r AS (SELECT key, CAST(hour AS DATE) AS day, hour, value, row_number() OVER (PARTITION BY key, CAST(hour AS DATE) ORDER BY hour) AS step FROM hourly) SELECT key, strftime(hour, '%Y-%m-%d %H') AS hour, round(CASE WHEN step = 1 THEN value ELSE step * value - (step - 1) * lag(value) OVER (PARTITION BY key, day ORDER BY step) END, 9) AS mean_of_hour FROM r")
def win_17_deaccumulate(spark: SparkSession, d: str) -> DataFrame:
    h = windows.turns(hourly_events(spark, d).withColumn("day", F.to_date("hour")), ["key", "day"], [F.col("hour")], "step")
    return h.select("key", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round(windows.deaccumulate(h, ["key", "day"], "step", "value"), 9).alias("mean_of_hour"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice) AS k, l_extendedprice AS p FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber) AS k2 FROM a WHERE k = 1) SELECT l_orderkey, l_linenumber, p AS overlap FROM b WHERE k2 = 1")
def win_19_latest_then_best(spark: SparkSession, d: str) -> DataFrame:
    latest = windows.top(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_quantity"), F.desc("l_partkey"), F.desc("l_suppkey"), F.col("l_extendedprice")])
    return windows.top(latest, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("overlap"))


@query(f"WITH {SAMPLES_SQL}, d AS (SELECT region_id, utc_day, dense_rank() OVER (PARTITION BY region_id ORDER BY utc_day) AS k FROM samples WHERE (region_id, utc_day) NOT IN (SELECT region_id, utc_day FROM samples WHERE phase = 'F')) SELECT DISTINCT region_id, CAST(utc_day AS VARCHAR) AS utc_day, k AS turn FROM d WHERE k <= 4")
def win_20_pending_dates(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    left = s.select("region_id", "utc_day").distinct().join(s.filter("phase = 'F'").select("region_id", "utc_day").distinct(), ["region_id", "utc_day"], "left_anti")
    return windows.top(left, ["region_id"], [F.col("utc_day")], 4, "turn").select("region_id", F.col("utc_day").cast("string").alias("utc_day"), F.col("turn").cast("long").alias("turn"))


@query("WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n = 1 THEN flag END AS l_returnflag, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'attached' ELSE 'conflict' END AS context_status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey")
def jn_24_consistent_attach(spark: SparkSession, d: str) -> DataFrame:
    batches = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return joins.attach_consistent(load(spark, d, "orders").select("o_orderkey"), batches, "o_orderkey", ["l_returnflag"])


@query("WITH i AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_linestatus) AS n, max(l_linestatus = 'O') AS f FROM lineitem GROUP BY 1, 2) SELECT s_suppkey, k AS line, CASE WHEN n IS NULL THEN 'NotListed' WHEN n > 1 THEN 'Unknown' WHEN f THEN 'Listed' ELSE 'ListedNoObstruction' END AS listing FROM (SELECT s_suppkey, CAST(unnest([1, 2, 3]) AS INT) AS k FROM supplier) LEFT JOIN i ON l_suppkey = s_suppkey AND l_linenumber = k")
def jn_21_status_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("line"))
    index = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "O").alias("flag"))
    return joins.status_lookup(names, index, ["s_suppkey", "line"], "flag")


@query(f"WITH {HOURLY_SQL} SELECT event_id, round(value * 2, 6) AS doubled FROM (SELECT event_id, h.value FROM events JOIN hourly h ON h.key = event_type AND h.hour = date_trunc('hour', ts))")
def jn_22_compute_once(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", F.col("event_type").alias("key"), F.date_trunc("hour", "ts").alias("hour"))
    hours = hourly_events(spark, d).select("key", "hour", "value")
    return joins.compute_once(e, ["key", "hour"], lambda keys: keys.join(hours, ["key", "hour"]).withColumn("doubled", F.col("value") * 2).drop("value")).select("event_id", _r("doubled"))


@query("SELECT 0 AS lost, 0 AS added, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS changed, count(*) AS rows FROM orders")
def jn_23_identity_audit(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    after = o.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return contracts.compare_identity(o, after, "o_orderkey", ["o_totalprice"]).select(F.col("lost").cast("int").alias("lost"), F.col("added").cast("int").alias("added"), "changed", "rows")


@query(f"WITH {HOURLY_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE h.value IS NULL) AS unmatched, count(*) FILTER (WHERE c.value IS NOT NULL) AS both_ends FROM events LEFT JOIN hourly h ON h.key = event_type AND h.hour = date_trunc('hour', ts) LEFT JOIN hourly c ON c.key = event_type AND c.hour = CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AND h.value IS NOT NULL")
def jn_28_exact_hour_audit(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_events(spark, d)
    e = events(spark, d).withColumns({"key": F.col("event_type"), "lo": floor_hour(F.col("ts")), "hi": ceil_hour(F.col("ts"))}).drop("value")
    one = e.join(h.select("key", F.col("hour").alias("lo"), F.col("value").alias("v")), ["key", "lo"], "left").join(h.select("key", F.col("hour").alias("hi"), F.col("value").alias("w")), ["key", "hi"], "left")
    return one.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("unmatched"), F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()).alias("both_ends"))


@query("SELECT n_name AS tile, strftime(h, '%Y-%m-%d %H') AS hour FROM nation, (SELECT DISTINCT date_trunc('day', ts) AS h FROM events)")
def jn_20_schedule(spark: SparkSession, d: str) -> DataFrame:
    hours = load(spark, d, "events").select(F.date_trunc("day", "ts").alias("stamp")).distinct()
    return joins.schedule(load(spark, d, "nation").select(F.col("n_name").alias("tile")), hours).select("tile", F.date_format("stamp", "yyyy-MM-dd HH").alias("hour"))
