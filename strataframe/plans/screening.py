"""Admission, splits, sets and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import contracts, splits, trials, windows
from ..session import load
from .registry import query
from .views import PREDICTED_SQL, SAMPLES_SQL, areas, predicted, samples, stations


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount = 0")
def flt_01_exact_zero(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose share is exactly 0; a share outside [0, 1] would be an error."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    contracts.require(rows, {"share in range": F.col("l_discount").between(0, 1)})
    return rows.filter("l_discount = 0").drop("l_discount")


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, concat_ws(';', CASE WHEN a IS NULL THEN 'no_prediction' END, CASE WHEN observed > 400 THEN 'implausible' END, CASE WHEN phase = 'P' THEN 'pending' END) AS reasons, a IS NOT NULL AND observed <= 400 AND phase <> 'P' AS eligible FROM predicted")
def flt_02_quarantine(spark: SparkSession, d: str) -> DataFrame:
    reasons = E.all_reasons([(F.col("a").isNull(), "no_prediction"), (F.col("observed") > 400, "implausible"), (F.col("phase") == "P", "pending")])
    return predicted(spark, d).select("sample_id", reasons.alias("reasons"), (reasons == "").alias("eligible"))


_ADMIT = [("a IS NOT NULL", "no_prediction"), ("observed <= 450", "implausible"), ("balance >= 0", "negative_balance"), ("abs(a - observed) <= 300", "large_error")]
_FIT = [("year(ts) <= 1999", "evaluation_year"), ("region_id <> 'NATION_3'", "withheld_region")]
_EVAL = [("year(ts) >= 2000", "not_evaluation_year")]


def _ladder_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{r}'" for c, r in rules) + " END"


_ADMIT_SQL = f"WITH {PREDICTED_SQL}, r AS (SELECT *, {_ladder_sql(_ADMIT)} AS reason FROM predicted), k AS (SELECT *, coalesce(reason, {_ladder_sql(_FIT)}) AS fit_reason, coalesce(reason, {_ladder_sql(_EVAL)}) AS evaluation_reason FROM r), admitted AS (SELECT *, CASE WHEN fit_reason IS NULL AND evaluation_reason IS NULL THEN 'both' WHEN fit_reason IS NULL THEN 'fit' WHEN evaluation_reason IS NULL THEN 'evaluation' ELSE 'excluded' END AS kind FROM k)"


def admitted(spark: SparkSession, d: str) -> DataFrame:
    rules = lambda pairs: [(F.expr(c), r) for c, r in pairs]
    return splits.admit(predicted(spark, d), rules(_ADMIT), rules(_FIT), rules(_EVAL))


@query(f"{_ADMIT_SQL} SELECT sample_id, reason, fit_reason, evaluation_reason, kind FROM admitted")
def flt_03_admission(spark: SparkSession, d: str) -> DataFrame:
    return admitted(spark, d).select("sample_id", "reason", "fit_reason", "evaluation_reason", "kind")


@query(f"{_ADMIT_SQL} SELECT kind, coalesce(fit_reason, '') AS fit_reason, count(*) AS n FROM admitted GROUP BY 1, 2")
def snk_02_disjoint_kinds(spark: SparkSession, d: str) -> DataFrame:
    return admitted(spark, d).groupBy("kind", F.coalesce("fit_reason", F.lit("")).alias("fit_reason")).agg(F.count(F.lit(1)).alias("n"))


_UNION = " UNION ALL ".join(f"SELECT '{r}' AS reason, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failures, count(*) FILTER (WHERE reason = '{r}') AS first_reason_rows FROM admitted" for c, r in _ADMIT)


@query(f"{_ADMIT_SQL} {_UNION}")
def flt_06_independent_failures(spark: SparkSession, d: str) -> DataFrame:
    return splits.independent_failures(predicted(spark, d), [(F.expr(c), r) for c, r in _ADMIT])


@query(f"""WITH {SAMPLES_SQL}, u AS (SELECT sample_id, acquisition_id, region_id, 'legacy' AS origin, 0 AS o FROM samples WHERE utc_day < DATE '1999-01-01' UNION ALL SELECT sample_id, acquisition_id, region_id, 'expanded', 1 FROM samples WHERE utc_day >= DATE '1997-01-01'),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY o) AS k FROM u) SELECT sample_id, origin, CASE WHEN k > 1 THEN 'duplicate_of_legacy' WHEN region_id = 'NATION_3' THEN 'withheld_region' END AS reason FROM k""")
def flt_04_cohort_merge(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("sample_id", "region_id", "utc_day")
    old = s.filter(F.col("utc_day") < F.to_date(F.lit("1999-01-01"))).withColumns({"origin": F.lit("legacy"), "o": F.lit(0)})
    new = s.filter(F.col("utc_day") >= F.to_date(F.lit("1997-01-01"))).withColumns({"origin": F.lit("expanded"), "o": F.lit(1)})
    ranked = windows.turns(old.unionByName(new), ["sample_id"], [F.col("o")], "k")
    return ranked.select("sample_id", "origin", E.first_reason([(F.col("k") > 1, "duplicate_of_legacy"), (F.col("region_id") == "NATION_3", "withheld_region")]).alias("reason"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, CAST(CASE WHEN balance IS NULL OR balance < -500 THEN 1 WHEN a IS NULL THEN 2 WHEN observed < 1 THEN 3 WHEN phase = 'P' THEN 7 ELSE 0 END AS INT) AS code FROM predicted")
def flt_05_support_code(spark: SparkSession, d: str) -> DataFrame:
    code = E.ladder([(F.col("balance").isNull() | (F.col("balance") < -500), 1), (F.col("a").isNull(), 2), (F.col("observed") < 1, 3), (F.col("phase") == "P", 7)], 0)
    return predicted(spark, d).select("sample_id", code.alias("code"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 31) = 0 AND ((l_partkey >> 8) & 3) < 2 AND (l_suppkey & 2174) = 0 AS usable FROM lineitem")
def flt_07_quality_bits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.scene_quality_ok(F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")).alias("usable"))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST((l_orderkey >> {2 * i}) & 3 AS INT) AS qc_{n}" for i, n in enumerate(E.QC_FIELDS)) + ", (l_orderkey & 3) = 0 AND ((l_orderkey >> 2) & 3) = 0 AND ((l_orderkey >> 4) & 3) = 0 AND ((l_orderkey >> 14) & 3) >= 0 AND l_quantity <= 40 AS native_qa_valid FROM lineitem")
def flt_08_swath_quality(spark: SparkSession, d: str) -> DataFrame:
    qc = E.swath_quality(F.col("l_orderkey").cast("int"))
    gates = [qc["mandatory"] == 0, qc["data"] == 0, qc["cloud"] == 0, qc["lst_error"] >= 0, F.col("l_quantity") <= 40]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(v.cast("int").alias(f"qc_{k}") for k, v in qc.items()), E.all_of(gates).alias("native_qa_valid"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, balance IS NOT NULL AND observed IS NOT NULL AS complete_a, a IS NOT NULL AND balance IS NOT NULL AS complete_b, a IS NOT NULL AND c IS NOT NULL AND balance IS NOT NULL AND observed IS NOT NULL AS complete_d FROM predicted")
def flt_12_completeness(spark: SparkSession, d: str) -> DataFrame:
    full = lambda *cs: E.all_of([E.finite(F.col(c)) for c in cs])
    return predicted(spark, d).select("sample_id", full("balance", "observed").alias("complete_a"), full("a", "balance").alias("complete_b"), full("a", "c", "balance", "observed").alias("complete_d"))


@query(f"WITH {SAMPLES_SQL}, f AS (SELECT sample_id, (region_id, utc_day) NOT IN (SELECT region_id, utc_day FROM samples WHERE phase = 'F') AS fresh FROM samples WHERE phase = 'O') SELECT fresh, count(*) AS n FROM f GROUP BY 1")
def flt_16_freshness(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    known = s.filter("phase = 'F'").select("region_id", "utc_day").distinct().withColumn("known", F.lit(True))
    return s.filter("phase = 'O'").join(known, ["region_id", "utc_day"], "left").groupBy(F.col("known").isNull().alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE l_shipdate < o_orderdate) AS future_source, count(*) FILTER (WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY) AS stale_source, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def flt_17_interval_guard(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return j.agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("future_source"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("stale_source"), F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey, CASE WHEN l.l_orderkey IS NULL THEN 'no_report_at_time' WHEN abs(l.q - o_totalprice / 10000) > 20 THEN 'value_differs' ELSE 'verified' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l.l_orderkey = o_orderkey")
def flt_19_verification_status(spark: SparkSession, d: str) -> DataFrame:
    report = load(spark, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    j = load(spark, d, "orders").select("o_orderkey", "o_totalprice").join(report, "o_orderkey", "left")
    return j.select("o_orderkey", E.ladder([(F.col("q").isNull(), "no_report_at_time"), (F.abs(F.col("q") - F.col("o_totalprice") / 10000) > 20, "value_differs")], "verified").alias("status"))


@query("SELECT count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 50) AS l_quantity, count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.08) AS l_discount, count(*) FILTER (WHERE l_tax NOT BETWEEN 0 AND 0.05) AS l_tax FROM lineitem")
def flt_20_range_checks(spark: SparkSession, d: str) -> DataFrame:
    ranges = {"l_quantity": (1, 50), "l_discount": (0, 0.08), "l_tax": (0, 0.05)}
    return load(spark, d, "lineitem").agg(*(F.count_if(~F.col(c).between(a, b)).alias(c) for c, (a, b) in ranges.items()))


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2001-01-01' - INTERVAL 400 DAY AND o_orderdate <= TIMESTAMP '2001-01-01') SELECT o_custkey, o_orderkey, CAST(k AS INT) AS place FROM s WHERE k <= 16")
def flt_21_trailing_candidates(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2001-01-01"))
    o = load(spark, d, "orders").filter((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") > at - F.expr("INTERVAL 400 DAY")) & (F.col("o_orderdate") <= at))
    return windows.top(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 16, "place").select("o_custkey", "o_orderkey", "place")


@query(f"WITH {SAMPLES_SQL}, r AS (SELECT CASE WHEN (region_id, utc_day) IN (SELECT region_id, utc_day FROM samples WHERE phase = 'F') THEN 'date_seen' WHEN balance < 0 THEN 'cloud' WHEN observed < 20 THEN 'footprint' ELSE 'queued' END AS reason FROM samples WHERE phase = 'O') SELECT reason, count(*) AS n FROM r GROUP BY 1")
def flt_22_queue_rejections(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    seen = s.filter("phase = 'F'").select("region_id", "utc_day").distinct().withColumn("seen", F.lit(True))
    reason = E.ladder([(F.col("seen").isNotNull(), "date_seen"), (F.col("balance") < 0, "cloud"), (F.col("observed") < 20, "footprint")], "queued")
    return s.filter("phase = 'O'").join(seen, ["region_id", "utc_day"], "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round((c - a) / CASE WHEN abs(b) > 1e-6 THEN b END, 9) AS relative, round(b - a, 9) AS difference FROM predicted")
def prj_02_contrasts(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.when(F.abs("b") > 1e-6, (F.col("c") - F.col("a")) / F.col("b"))
    return predicted(spark, d).select("sample_id", F.round(ratio, 9).alias("relative"), F.round(F.col("b") - F.col("a"), 9).alias("difference"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, CASE WHEN region_id IN ('NATION_3', 'NATION_7') THEN 'test_region' WHEN utc_day <= DATE '1998-12-31' THEN 'train' WHEN utc_day <= DATE '1999-12-31' THEN 'calibration' ELSE 'test_temporal' END AS split, CASE WHEN utc_day <= DATE '1998-12-31' THEN 'training_dates' WHEN utc_day <= DATE '1999-12-31' THEN 'calibration_dates' ELSE 'future_dates' END AS time_period FROM samples")
def spl_01_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(samples(spark, d), F.col("utc_day"), F.col("region_id").isin("NATION_3", "NATION_7"), "1998-12-31", "1999-12-31").select("sample_id", "split", "time_period")


@query(f"WITH {SAMPLES_SQL}, s AS (SELECT *, CASE WHEN region_id IN ('NATION_3', 'NATION_7') THEN 'test_region' WHEN utc_day <= DATE '1998-12-31' THEN 'train' WHEN utc_day <= DATE '1999-12-31' THEN 'calibration' ELSE 'test_temporal' END AS split FROM samples) SELECT split, count(*) AS rows, count(DISTINCT utc_day) AS days, count(*) >= 100 AND count(DISTINCT utc_day) >= 30 AS supported FROM s GROUP BY 1")
def spl_02_validate(spark: SparkSession, d: str) -> DataFrame:
    s = splits.assign_splits(samples(spark, d), F.col("utc_day"), F.col("region_id").isin("NATION_3", "NATION_7"), "1998-12-31", "1999-12-31")
    return splits.validate_splits(s, "split", "utc_day", {k: (100, 30) for k in ("train", "calibration", "test_region", "test_temporal")})


@query(f"WITH {SAMPLES_SQL}, t AS (SELECT *, CASE WHEN utc_day < DATE '1999-01-01' THEN 'fit' WHEN utc_day < DATE '1999-07-01' THEN 'development' ELSE 'calibration' END AS temporal_partition FROM samples) SELECT sample_id, temporal_partition, CASE WHEN region_id = 'NATION_3' THEN 'heldout_region' WHEN acquisition_id % 5 = 0 THEN 'heldout_spatial' WHEN acquisition_id % 5 = 1 THEN 'excluded_buffer' WHEN phase = 'P' THEN 'excluded_twilight' ELSE temporal_partition END AS split, CASE WHEN balance <= 0 THEN 'cold' WHEN balance >= 30 THEN 'hot' ELSE 'mild' END AS air_group, CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) <= 5 THEN 'MAM' WHEN month(ts) <= 8 THEN 'JJA' ELSE 'SON' END AS season FROM t")
def spl_03_overlay(spark: SparkSession, d: str) -> DataFrame:
    temporal = E.split_by_date(F.col("utc_day"), [("1999-01-01", "fit"), ("1999-07-01", "development")], "calibration")
    rules = [(F.col("region_id") == "NATION_3", "heldout_region"), (F.col("acquisition_id") % 5 == 0, "heldout_spatial"), (F.col("acquisition_id") % 5 == 1, "excluded_buffer"), (F.col("phase") == "P", "excluded_twilight")]
    out = splits.overlay_splits(samples(spark, d), temporal, rules)
    return out.select("sample_id", "temporal_partition", "split", E.air_group(F.col("balance")).alias("air_group"), E.season(F.col("ts")).alias("season"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, CAST(((year(ts) - 1995) * 12 + month(ts) - 1) % 3 AS INT) AS fold FROM samples")
def spl_04_month_folds(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("sample_id", E.month_fold(F.col("ts"), 1995).cast("int").alias("fold"))


_SPLIT_SQL = f"""WITH {SAMPLES_SQL}, g AS (SELECT sample_id, region_id, acquisition_id AS granule, month AS mid, month AS m0, strftime(ts + INTERVAL 2 DAY, '%Y-%m') AS m1 FROM samples),
cat AS (SELECT 'pilot' AS mode, n_name AS key FROM nation WHERE n_nationkey BETWEEN 1 AND 4 UNION ALL SELECT 'month', unnest(['1996-03', '1998-07']) UNION ALL SELECT 'reference', 'NATION_0'),
fitp AS (SELECT * FROM g WHERE region_id <> 'NATION_0'),
heldg AS (SELECT mode, key, g.* FROM g JOIN cat ON mode IN ('pilot', 'reference') AND region_id = key), heldm AS (SELECT mode, key, fitp.* FROM fitp JOIN cat ON mode = 'month' AND mid = key),
touched AS (SELECT DISTINCT mode, key, granule FROM heldg UNION SELECT mode, key, granule FROM g JOIN cat ON mode = 'month' AND (m0 = key OR m1 = key)),
train AS (SELECT c.mode, c.key, fitp.* FROM fitp, cat c WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.mode = c.mode AND t.key = c.key AND t.granule = fitp.granule))
SELECT mode, key, 'held' AS role, count(*) AS n FROM (SELECT * FROM heldg UNION ALL SELECT * FROM heldm) GROUP BY 1, 2 UNION ALL SELECT mode, key, 'train', count(*) FROM train GROUP BY 1, 2"""


@query(_SPLIT_SQL)
def spl_05_leave_out(spark: SparkSession, d: str) -> DataFrame:
    g = samples(spark, d).select("sample_id", "region_id", F.col("acquisition_id").alias("granule"), F.col("month").alias("mid"), F.col("month").alias("m0"), F.date_format(F.col("ts") + F.expr("INTERVAL 2 DAYS"), "yyyy-MM").alias("m1"))
    n = load(spark, d, "nation")
    one = n.filter("n_nationkey = 0")
    catalogue = n.filter("n_nationkey BETWEEN 1 AND 4").select(F.lit("pilot").alias("mode"), F.col("n_name").alias("key")).union(one.select(F.lit("month"), F.explode(F.array(F.lit("1996-03"), F.lit("1998-07"))))).union(one.select(F.lit("reference"), "n_name"))
    excluded = trials.exclusions(g, catalogue, "granule", "region_id", "m0", "m1")
    train = trials.train_counts(g.filter("region_id <> 'NATION_0'"), catalogue, excluded, "granule").select("mode", "key", F.lit("train").alias("role"), "n")
    held = trials.held_rows(g, catalogue, "region_id", "mid", ["NATION_0"]).groupBy("mode", "key").agg(F.count(F.lit(1)).alias("n"))
    return train.union(held.select("mode", "key", F.lit("held"), "n"))


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT acquisition_id, phase, count(DISTINCT utc_day) AS dates FROM samples GROUP BY 1, 2) SELECT sample_id, CASE WHEN dates < 2 THEN 'excluded_sparse_fit' ELSE 'fit' END AS split FROM samples JOIN c USING (acquisition_id, phase)")
def spl_08_sparse_groups(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    few = s.groupBy("acquisition_id", "phase").agg(F.count_distinct("utc_day").alias("dates"))
    return s.join(few, ["acquisition_id", "phase"]).select("sample_id", F.when(F.col("dates") < 2, "excluded_sparse_fit").otherwise("fit").alias("split"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, count(*) AS rows, count(DISTINCT utc_day) AS dates, count(*) >= 80 AND count(DISTINCT utc_day) >= 2 AS eligible FROM samples GROUP BY 1, 2")
def spl_11_recipe_support(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("region_id", "phase").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("utc_day").alias("dates")).withColumn("eligible", (F.col("rows") >= 80) & (F.col("dates") >= 2))


@query(f"WITH {SAMPLES_SQL} SELECT CASE WHEN utc_day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'fit' WHEN utc_day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' THEN 'development' WHEN utc_day BETWEEN DATE '1998-07-01' AND DATE '1998-12-31' THEN 'calibration' WHEN year(utc_day) = 1999 THEN 'reserved_legacy' ELSE 'outside_frozen_protocol' END AS split, count(*) AS n FROM samples GROUP BY 1")
def spl_12_protocol_split(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("utc_day")
    within = lambda a, b: day.between(F.to_date(F.lit(a)), F.to_date(F.lit(b)))
    label = E.ladder([(within("1996-01-01", "1997-12-31"), "fit"), (within("1998-01-01", "1998-06-30"), "development"), (within("1998-07-01", "1998-12-31"), "calibration"), (F.year(day) == 1999, "reserved_legacy")], "outside_frozen_protocol")
    return samples(spark, d).groupBy(label.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, r AS row, c AS col, (r + 2 * c) % 5 = 0 AS spatial_holdout FROM supplier, (SELECT CAST(unnest(range(0, 5)) AS INT) AS r), (SELECT CAST(unnest(range(0, 4)) AS INT) AS c)")
def spl_13_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return b.withColumn("spatial_holdout", (F.col("row") + 2 * F.col("col")) % 5 == 0)


_AREAS = "SELECT n_nationkey AS area, 300000 + n_nationkey * 1237 AS x0, 5000000 + n_nationkey * 911 AS y0, 300000 + n_nationkey * 1237 + 12345 + n_nationkey * 7777 AS x1, 5000000 + n_nationkey * 911 + 9999 + n_nationkey * 5551 AS y1 FROM nation"


@query(f"""WITH a AS ({_AREAS}), r AS (SELECT *, unnest(range(CAST(ceil((y1 - y0) / 10000.0) AS BIGINT))) AS row FROM a), b AS (SELECT *, unnest(range(CAST(ceil((x1 - x0) / 10000.0) AS BIGINT))) AS col FROM r)
SELECT area, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(x0 + col * 10000 AS DOUBLE) AS west, CAST(y0 + row * 10000 AS DOUBLE) AS south, CAST(least(x0 + (col + 1) * 10000, x1) AS DOUBLE) AS east, CAST(least(y0 + (row + 1) * 10000, y1) AS DOUBLE) AS north, (row + 2 * col) % 5 = 0 AS spatial_holdout FROM b""")
def spl_13_area_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 10 km over each area's own extent, cut at its edges, one in five held out."""
    n = F.col("n_nationkey")
    left, bottom = 300000 + n * 1237, 5000000 + n * 911
    areas = load(spark, d, "nation").select(n.alias("area"), left.alias("x0"), bottom.alias("y0"), (left + 12345 + n * 7777).alias("x1"), (bottom + 9999 + n * 5551).alias("y1"))
    return splits.area_blocks(areas, ["x0", "y0", "x1", "y1"], 10_000.0).select("area", "row", "col", "west", "south", "east", "north", "spatial_holdout")


@query("SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def set_01_tagged_union(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set_02_duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return contracts.duplicates(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_03_key_difference(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query(f"{_ADMIT_SQL} SELECT kind, CAST(0 AS BIGINT) AS left_over, count(*) AS n FROM admitted GROUP BY 1")
def set_05_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    rows = admitted(spark, d)
    parts = {k: rows.filter(F.col("kind") == k).drop("kind") for k in ("fit", "evaluation", "both", "excluded")}
    union = splits.require_disjoint(parts, ["sample_id"])
    rest = rows.select("sample_id").exceptAll(union.select("sample_id")).count()
    return union.groupBy("kind").agg(F.lit(rest).cast("long").alias("left_over"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES_SQL}, u AS (SELECT region_id, utc_day, 'samples' AS source FROM samples WHERE phase = 'F' UNION ALL SELECT region_id, utc_day, 'manifest' FROM samples WHERE phase = 'P') SELECT region_id, CAST(utc_day AS VARCHAR) AS utc_day, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM u GROUP BY 1, 2")
def set_06_date_registry(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    u = s.filter("phase = 'F'").select("region_id", "utc_day", F.lit("samples").alias("source")).union(s.filter("phase = 'P'").select("region_id", "utc_day", F.lit("manifest")))
    return u.groupBy("region_id", "utc_day").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).withColumn("utc_day", F.col("utc_day").cast("string"))


@query("""WITH m AS (SELECT l_orderkey AS k, CAST(l_suppkey % 3 AS VARCHAR) AS dg, CASE WHEN l_linestatus = 'O' THEN 'complete' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'odd' END AS st FROM lineitem), a AS (SELECT k, count(DISTINCT CASE WHEN st = 'complete' THEN dg END) AS versions, min(CASE WHEN st = 'complete' THEN dg END) AS digest, count(*) FILTER (WHERE st = 'odd') AS unknown, count(*) FILTER (WHERE st = 'failed') AS failed FROM m GROUP BY 1)
SELECT k, versions, digest, unknown, failed, CASE WHEN unknown > 0 THEN 'unknown_status' WHEN versions > 1 THEN 'conflict' WHEN versions = 1 THEN 'accepted' ELSE 'failed_only' END AS outcome FROM a""")
def set_07_manifest_union(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 3).cast("string").alias("dg"), F.when(F.col("l_linestatus") == "O", "complete").when(F.col("l_returnflag") == "R", "failed").otherwise("odd").alias("st"))
    return splits.manifest_union(m, "k", "dg", "st", ["complete", "failed"])


@query("SELECT l_orderkey, l_linenumber, round(l_partkey * 2.75e-5 - 0.2, 9) AS reflectance, round(l_partkey * 0.00341802 + 149.0 - 273.15, 9) AS temperature_c, round(CASE WHEN abs(l_tax + l_discount) > 1e-6 THEN (l_tax - l_discount) / (l_tax + l_discount) END, 9) AS nd, round(0.356 * l_tax + 0.130 * l_discount + 0.373 * l_tax + 0.085 * l_discount + 0.072 * l_tax - 0.0018, 9) AS albedo FROM lineitem")
def sc_01_spectral(spark: SparkSession, d: str) -> DataFrame:
    """Scaling, normalised difference and albedo proxy (SC-01 to SC-03)."""
    t, o = F.col("l_tax"), F.col("l_discount")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(E.reflectance(F.col("l_partkey")), 9).alias("reflectance"), F.round(E.surface_temperature_c(F.col("l_partkey")), 9).alias("temperature_c"), F.round(E.normalised_difference(t, o), 9).alias("nd"), F.round(E.albedo_proxy(t, o, t, o, t), 9).alias("albedo"))


_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"
_PLACES = "areas AS (SELECT n_name AS area_id, n_nationkey * 523 % 1100 / 10.0 - 55 AS lat, n_nationkey * 1301 % 3600 / 10.0 - 180 AS lon FROM nation), stations AS (SELECT s_suppkey AS station_id, s_suppkey * 7919 % 1200 / 10.0 - 60 AS lat, s_suppkey * 104729 % 3600 / 10.0 - 180 AS lon FROM supplier)"


@query(f"WITH {_PLACES}, k AS (SELECT area_id, station_id, {_HAV} AS km FROM areas a, stations b), t AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY km, station_id) AS k FROM k WHERE km <= 2500) SELECT area_id, station_id, round(km, 6) AS distance_km, CAST(k AS INT) AS station_rank FROM t WHERE k <= 5")
def jn_10_within_distance(spark: SparkSession, d: str) -> DataFrame:
    """With the great-circle distance (SC-04)."""
    from ..operators.joins import within_distance

    return within_distance(areas(spark, d), stations(spark, d), "area_id", "station_id", 2500, 5).select("area_id", "station_id", _r("distance_km"), "station_rank")


@query("SELECT event_id, round(sin(2 * pi() / 24 * ((hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 + (user_id % 360 - 180) / 15.0 + 48) % 24)), 8) AS hour_sin, round(cos(2 * pi() / 365.2425 * dayofyear(ts)), 8) AS day_cos, quarter(ts) AS quarter, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS floor_hour, round(epoch(ts - date_trunc('hour', ts)) / 60, 4) AS partial_minutes FROM events")
def sc_09_time(spark: SparkSession, d: str) -> DataFrame:
    """Hours, cycles and calendar fields (SC-09 to SC-11)."""
    ts = F.col("ts")
    hour = E.local_solar_hour(ts, (F.col("user_id") % 360 - 180).cast("double"))
    return load(spark, d, "events").select("event_id", F.round(E.cyclic(hour, 24)[0], 8).alias("hour_sin"), F.round(E.cyclic(F.dayofyear(ts), 365.2425)[1], 8).alias("day_cos"), F.quarter(ts).cast("long").alias("quarter"), F.date_format(E.floor_hour(ts), "yyyy-MM-dd HH").alias("floor_hour"), F.round(E.age_minutes(ts, E.floor_hour(ts)), 4).alias("partial_minutes"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, CAST(least(make_date(2024, month(utc_day), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY, make_date(2024, month(utc_day), 1) + to_days(CAST(day(utc_day) - 1 AS INT))) AS DATE)::VARCHAR AS same_season, CAST(least(abs(dayofyear(utc_day) - 10), 365 - abs(dayofyear(utc_day) - 10)) AS INT) AS days FROM samples")
def sc_13_same_season(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("utc_day")
    return samples(spark, d).select("sample_id", E.same_season_date(day, F.lit(2024)).cast("string").alias("same_season"), E.circular_days(F.dayofyear(day), F.lit(10)).cast("int").alias("days"))


@query()
def sc_14_civil_time(spark: SparkSession, d: str) -> DataFrame:
    local, same = E.local_time(F.col("ts"), "Europe/London")
    return load(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), same.alias("unambiguous"))


_LAST_SUNDAY = "make_date(y, {0}, 31) - to_days(CAST(dayofweek(make_date(y, {0}, 31)) AS INT)) + INTERVAL 1 HOUR"


@query(f"""WITH e AS (SELECT event_id, ts + to_days(CAST(event_id % 731 AS INT)) AS ts FROM events), y AS (SELECT *, CAST(year(ts) AS INT) AS y FROM e), s AS (SELECT *, {_LAST_SUNDAY.format(3)} AS spring, {_LAST_SUNDAY.format(10)} AS autumn FROM y)
SELECT event_id, strftime(CASE WHEN ts >= spring AND ts < autumn THEN ts + INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M') AS local, NOT (ts >= autumn AND ts < autumn + INTERVAL 1 HOUR) AS unambiguous FROM s""")
def sc_14_civil_times_of_the_year(spark: SparkSession, d: str) -> DataFrame:
    """Civil times over two years, both changes of the clock among them; the SQL has the rule of the last Sundays."""
    moved = load(spark, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval((F.col("event_id") % 731).cast("int"))).alias("ts"))
    local, same = E.local_time(F.col("ts"), "Europe/London")
    return moved.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), same.alias("unambiguous"))


def solar_sql(base: str, keep: str) -> str:
    """Steps to the solar elevation (as ``elevation``, in degrees) of a base query with ts, lat and lon."""
    r = "pi() / 180"
    steps = [
        ("q0", base),
        ("q1", "SELECT *, (epoch(ts) / 86400 + 2440587.5 - 2451545) / 36525 AS t FROM q0"),
        ("q2", f"SELECT *, (280.46646 + t * (36000.76983 + 0.0003032 * t)) % 360 AS l, (357.52911 + t * (35999.05029 - 0.0001537 * t)) * {r} AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, (125.04 - 1934.136 * t) * {r} AS om FROM q1"),
        ("q3", f"SELECT *, (l + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + 0.000289 * sin(3 * m) - 0.00569 - 0.00478 * sin(om)) * {r} AS la, (23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - 0.001813 * t))) / 60) / 60 + 0.00256 * cos(om)) * {r} AS ep, l * {r} AS lr FROM q2"),
        ("q4", "SELECT *, asin(sin(ep) * sin(la)) AS de, pow(tan(ep / 2), 2) AS y FROM q3"),
        ("q5", f"SELECT *, 4 / ({r}) * (y * sin(2 * lr) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * lr) - 0.5 * y * y * sin(4 * lr) - 1.25 * e * e * sin(2 * m)) AS eq FROM q4"),
        ("q6", f"SELECT *, ((((epoch(ts) % 86400) / 60 + eq + 4 * lon + 1440) % 1440) / 4 - 180) * {r} AS ha FROM q5"),
    ]
    return ", ".join(f"{n} AS ({s})" for n, s in steps) + f", solar AS (SELECT {keep}, asin(greatest(-1, least(1, sin(lat * {r}) * sin(de) + cos(lat * {r}) * cos(de) * cos(ha)))) / ({r}) AS elevation FROM q6)"


_SUN = solar_sql("SELECT *, CAST(user_id % 120 - 60 AS DOUBLE) AS lat, CAST(user_id * 37 % 360 - 180 AS DOUBLE) AS lon FROM events", "event_id")


@query(f"WITH {_SUN} SELECT event_id, round(elevation, 6) AS elevation FROM solar")
def sc_15_solar_elevation(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(E.solar_elevation(F.col("ts"), (F.col("user_id") % 120 - 60).cast("double"), (F.col("user_id") * 37 % 360 - 180).cast("double")), 6).alias("elevation"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 1000 THEN 'day' WHEN c_acctbal <= -600 THEN 'night' ELSE 'twilight' END AS phase, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal <= 0 THEN 'low' WHEN c_acctbal <= 5000 THEN 'middle' ELSE 'high' END AS bin FROM customer")
def sc_16_phases_and_bins(spark: SparkSession, d: str) -> DataFrame:
    """Phase thresholds and right-closed bins (SC-16, SC-19)."""
    b = F.col("c_acctbal")
    return load(spark, d, "customer").select("c_custkey", E.light_phase(b, 1000, -600).alias("phase"), E.cut(b, [0, 5000], ["low", "middle", "high"]).alias("bin"))


@query(f"""WITH x AS (SELECT s_suppkey, s_suppkey % 181 - 90 AS lat, s_suppkey % 365 * 2 * pi() / 365 AS a FROM supplier), y AS (SELECT *, 0.006918 - 0.399912 * cos(a) + 0.070257 * sin(a) - 0.006758 * cos(2 * a) + 0.000907 * sin(2 * a) - 0.002697 * cos(3 * a) + 0.00148 * sin(3 * a) AS de, 1.00011 + 0.034221 * cos(a) + 0.00128 * sin(a) + 0.000719 * cos(2 * a) + 0.000077 * sin(2 * a) AS f FROM x),
z AS (SELECT *, sin(radians(lat)) * sin(de) AS p, cos(radians(lat)) * cos(de) AS q FROM y), h AS (SELECT *, CASE WHEN p - q >= 0 THEN pi() WHEN p + q <= 0 THEN 0 ELSE acos(greatest(-1, least(1, -p / q))) END AS h FROM z) SELECT s_suppkey, round(greatest(0, {E.SOLAR_CONSTANT} * f / pi() * (h * p + q * sin(h))), 6) AS irradiance FROM h""")
def sc_17_daily_irradiance(spark: SparkSession, d: str) -> DataFrame:
    angle = F.col("s_suppkey") % 365 * (2 * math.pi / 365)
    return load(spark, d, "supplier").select("s_suppkey", F.round(E.toa_daily_mean((F.col("s_suppkey") % 181 - 90).cast("double"), angle), 6).alias("irradiance"))


@query("SELECT p_partkey, coalesce(list_extract([" + ", ".join(f"'{c}'" for c in E.CLIMATE_CLASSES) + "], CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size END), 'unknown') AS climate FROM part")
def sc_18_climate_labels(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", E.climate_label(F.col("p_size")).alias("climate"))


@query(f"WITH {_PLACES} SELECT station_id, CASE WHEN lat >= 84 THEN 'ups-n' WHEN lat < -80 THEN 'ups-s' ELSE 'utm-' || lpad(CAST(CAST(floor((lon + 180) / 6) + 1 AS INT) AS VARCHAR), 2, '0') || CASE WHEN lat >= 0 THEN 'n' ELSE 's' END END AS zone, CAST(floor((90 - lat) * 4 + 0.5) AS INT) AS row, CAST(floor((lon + 360) % 360 * 4 + 0.5) % 1440 AS INT) AS col FROM stations")
def sc_21_zones_and_cells(spark: SparkSession, d: str) -> DataFrame:
    """Zone ownership and nearest grid index (SC-21, SC-22)."""
    row, col = E.nearest_index(F.col("lat"), F.col("lon"), 4)
    return stations(spark, d).select("station_id", E.zone_id(F.col("lat"), F.col("lon")).alias("zone"), row.alias("row"), col.cast("int").alias("col"))


@query(r"SELECT page_id, regexp_replace(url, '\?[^#\s]*', '?[redacted]') AS redacted, sha256(concat_ws(':', CAST(page_id AS VARCHAR), url)) AS key FROM pages")
def sc_28_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Query strings taken off and key digests (SC-28, SC-29)."""
    return load(spark, d, "pages").select("page_id", E.redact_query(F.col("url")).alias("redacted"), E.key_digest(F.col("page_id"), F.col("url")).alias("key"))


@query(f"WITH {PREDICTED_SQL} SELECT sample_id, round(a + greatest(-20, least(20, 0.5 * (c - a))), 5) AS blended FROM predicted WHERE a IS NOT NULL")
def sc_31_bounded_blend(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).filter("a IS NOT NULL").select("sample_id", F.round(E.bounded_blend(F.col("a"), F.col("c"), 0.5, 20.0), 5).alias("blended"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, CASE WHEN ts <= TIMESTAMP '1999-01-01' THEN 'final' WHEN ts <= TIMESTAMP '2000-06-01' THEN 'provisional' ELSE 'forecast' END AS weather_source FROM samples")
def sc_33_source_choice(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return samples(spark, d).select("sample_id", E.ladder([(ts <= F.to_timestamp(F.lit("1999-01-01")), "final"), (ts <= F.to_timestamp(F.lit("2000-06-01")), "provisional")], "forecast").alias("weather_source"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, sample_id FROM samples ORDER BY region_id, phase DESC, observed DESC, sample_id")
def srt_01_total_order(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).orderBy("region_id", F.desc("phase"), F.desc("observed"), "sample_id").select("region_id", "phase", "sample_id")


@query(f"WITH {SAMPLES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY observed DESC, sample_id) AS k FROM samples) SELECT region_id, sample_id FROM k WHERE k <= 8 ORDER BY observed DESC, sample_id LIMIT 60")
def srt_02_quota_then_top(spark: SparkSession, d: str) -> DataFrame:
    return windows.top(samples(spark, d), ["region_id"], [F.desc("observed"), F.col("sample_id")], 8).orderBy(F.desc("observed"), "sample_id").limit(60).select("region_id", "sample_id")


@query(f"WITH {SAMPLES_SQL} SELECT sample_id FROM samples ORDER BY sha256('5:' || sample_id), sample_id LIMIT 1000")
def srt_03_seeded_cap(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).orderBy(windows.hash_order("sample_id", 5), "sample_id").limit(1000).select("sample_id")
