"""Weights, metrics, acceptance and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import month_fold, season
from ..operators import contracts, digests, estimate, joins, metrics, windows
from ..session import load
from ..store import written
from .registry import query
from .views import PREDICTED_SQL, SAMPLES_SQL, predicted, samples

LEVELS = (["region_id", "phase"], ["utc_day"], ["acquisition_id"], ["surface"])


def _r(c: str, digits: int = 6) -> object:
    return F.round(c, digits).alias(c)


def _weights_sql(source: str, segment: str = "") -> str:
    """CTE w: nested weights within a segment, from a CTE with the sample columns."""
    p = f"{segment}, " if segment else ""
    part = lambda cols: f"PARTITION BY {p}{cols}" if p or cols else ""
    over = lambda x, cols: f"count(DISTINCT {x}) OVER ({part(cols).rstrip(', ')})"
    return f"""w AS (SELECT *, 1.0 / ({over("region_id || '/' || phase", '')} * {over('utc_day', 'region_id, phase')} * {over('acquisition_id', 'region_id, phase, utc_day')}
      * {over('surface', 'region_id, phase, utc_day, acquisition_id')} * count(*) OVER ({part('region_id, phase, utc_day, acquisition_id, surface')})) AS weight FROM {source})"""


@query(f"WITH {SAMPLES_SQL}, {_weights_sql('samples')} SELECT sample_id, round(weight * 1e6, 6) AS weight_ppm FROM w")
def win_01_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return windows.balanced_weights(samples(spark, d), LEVELS).select("sample_id", F.round(F.col("weight") * 1e6, 6).alias("weight_ppm"))


@query(f"""WITH {SAMPLES_SQL}, g AS (SELECT *, observed / sum(observed) OVER (PARTITION BY region_id, phase, utc_day, acquisition_id) / count(DISTINCT acquisition_id) OVER (PARTITION BY region_id, phase, utc_day)
  / count(DISTINCT utc_day) OVER (PARTITION BY region_id, phase) / (SELECT count(*) FROM (SELECT DISTINCT region_id, phase FROM samples)) AS weight FROM samples)
  SELECT sample_id, round(weight * 1e6, 6) AS weight_ppm FROM g""")
def win_02_area_weights(spark: SparkSession, d: str) -> DataFrame:
    return windows.area_weights(samples(spark, d), ["region_id", "phase"], "utc_day", "acquisition_id", "observed").select("sample_id", F.round(F.col("weight") * 1e6, 6).alias("weight_ppm"))


@query(f"""WITH {SAMPLES_SQL}, {_weights_sql('samples')}, h AS (SELECT *, weight * CASE WHEN utc_day >= DATE '1999-01-01' THEN 0.5 ELSE 1.0 END AS w2 FROM w)
  SELECT sample_id, round(w2 * sum(weight) OVER (PARTITION BY region_id, phase) / sum(w2) OVER (PARTITION BY region_id, phase) * 1e6, 5) AS weight_ppm FROM h""")
def win_13_conservative_weights(spark: SparkSession, d: str) -> DataFrame:
    w = windows.balanced_weights(samples(spark, d), LEVELS)
    return windows.conservative_weights(w, "weight", F.col("utc_day") >= F.to_date(F.lit("1999-01-01")), ["region_id", "phase"]).select("sample_id", F.round(F.col("weight") * 1e6, 5).alias("weight_ppm"))


@query(f"WITH {PREDICTED_SQL} SELECT region_id, count(c - observed) AS n, round(avg(abs(c - observed)), 6) AS mae, round(sqrt(avg((c - observed) * (c - observed))), 6) AS rmse, round(avg(c - observed), 6) AS bias FROM predicted GROUP BY region_id")
def agg_01_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("c") - F.col("observed")
    return predicted(spark, d).groupBy("region_id").agg(*metrics.error_metrics(e)).select("region_id", "n", *(_r(c) for c in ("mae", "rmse", "bias")))


_BLOCK = """count(*) AS n, count(DISTINCT region_id || '/' || CAST(utc_day AS VARCHAR)) AS date_count, count(DISTINCT region_id || '/' || CAST(acquisition_id AS VARCHAR)) AS acquisition_count, round(sum(weight * abs(e)), 8) AS mae, round(sqrt(sum(weight * e * e)), 8) AS rmse, round(sum(weight * e), 8) AS bias,
  round(sum(weight * CASE WHEN abs(e) > 50 THEN 1.0 ELSE 0.0 END), 8) AS fraction_gt_50, round(sum(weight * CASE WHEN abs(e) > 100 THEN 1.0 ELSE 0.0 END), 8) AS fraction_gt_100, round(sum(weight * abs(e - m)), 8) AS contrast_mae, round(avg(abs(e)), 8) AS unweighted_mae,
  CASE WHEN count(DISTINCT region_id || '/' || CAST(utc_day AS VARCHAR)) >= 2 THEN 'exploratory' ELSE 'unsupported_single_date' END AS status"""
_SEG_SQL = """seg AS (SELECT *, unnest([{{'t': 'overall', 's': 'all'}}, {{'t': 'by_region', 's': region_id}}, {{'t': 'by_phase', 's': phase}}, {{'t': 'by_product', 's': product}}, {{'t': 'by_region_phase', 's': region_id || '|' || phase}}]) AS seg0 FROM {0}),
seg1 AS (SELECT *, seg0.t AS segment_type, seg0.s AS segment FROM seg)"""
FAMILIES = {"overall": [], "by_region": ["region_id"], "by_phase": ["phase"], "by_product": ["product"], "by_region_phase": ["region_id", "phase"]}
_METRIC_COLUMNS = ("mae", "rmse", "bias", "fraction_gt_50", "fraction_gt_100", "contrast_mae", "unweighted_mae")


def _scored(df: DataFrame, segment: list[str]) -> DataFrame:
    used = dict.fromkeys([*segment, *(c for level in LEVELS for c in level), "e"])
    weighted = written(windows.balanced_weights(df.select(*used), LEVELS, segment), "weighted")
    out = metrics.weighted_metrics(weighted, segment, "e", "weight", ["region_id", "acquisition_id"], ["region_id", "utc_day"], [50, 100])
    return out.select(*segment, "n", "date_count", "acquisition_count", *(_r(c, 8) for c in _METRIC_COLUMNS), "status")


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, b - observed AS e FROM predicted WHERE b IS NOT NULL), {_weights_sql('ok', 'phase')}, x AS (SELECT *, sum(e * weight) OVER (PARTITION BY phase, region_id, acquisition_id) / sum(weight) OVER (PARTITION BY phase, region_id, acquisition_id) AS m FROM w) SELECT phase, {_BLOCK} FROM x GROUP BY phase")
def agg_02_weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _scored(predicted(spark, d).filter("b IS NOT NULL").withColumn("e", F.col("b") - F.col("observed")), ["phase"])


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, b - observed AS e FROM predicted WHERE b IS NOT NULL), {_SEG_SQL.format('ok')}, {_weights_sql('seg1', 'segment_type, segment')}, x AS (SELECT *, sum(e * weight) OVER (PARTITION BY segment_type, segment, region_id, acquisition_id) / sum(weight) OVER (PARTITION BY segment_type, segment, region_id, acquisition_id) AS m FROM w) SELECT segment_type, segment, {_BLOCK} FROM x GROUP BY segment_type, segment")
def agg_03_segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    ok = predicted(spark, d).filter("b IS NOT NULL").withColumn("e", F.col("b") - F.col("observed"))
    out = metrics.segment_blocks(ok, FAMILIES, LEVELS, "e", ["region_id", "acquisition_id"], ["region_id", "utc_day"], [50, 100])
    return out.select("segment_type", "segment", "n", "date_count", "acquisition_count", *(_r(c, 8) for c in _METRIC_COLUMNS), "status")


_LONG_SQL = "long AS (SELECT sample_id, region_id, phase, utc_day, acquisition_id, surface, product, observed, unnest(['a', 'b', 'c']) AS model, unnest([a, b, c]) - observed AS e FROM predicted)"


def _long(spark: SparkSession, d: str) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("observed")).alias("e")) for m in "abc"))).alias("m")
    return predicted(spark, d).select("*", models).select("*", "m.model", "m.e").drop("m", "a", "b", "c")


def _stacked(wide: DataFrame, keys: list[str], kinds: dict[str, dict[str, str]], columns: list[str]) -> DataFrame:
    """A row for each kind that has rows, from the columns that end in its name."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in labels.items()), *(F.col(f"{c}_{name}").alias(c) for c in columns)) for name, labels in kinds.items()))
    return wide.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*").filter("n > 0")


@query(f"WITH {PREDICTED_SQL}, {_LONG_SQL}, ok AS (SELECT * FROM long WHERE e IS NOT NULL), {_SEG_SQL.format('ok')}, {_weights_sql('seg1', 'model, segment_type, segment')} SELECT model, segment_type, segment, count(*) AS n, count(*) FILTER (WHERE abs(e) > 50) AS rows_gt_50, count(*) FILTER (WHERE abs(e) > 100) AS rows_gt_100, round(sum(weight * abs(e)), 8) AS mae FROM w GROUP BY ALL")
def agg_04_model_segments(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d)
    errors = {m: F.abs(F.col(m) - F.col("observed")) for m in "abc"}  # models side by side: no row is copied for a model
    one = lambda c: F.when(c, 1).otherwise(0)
    totals = {f"{k}_{m}": v for m, e in errors.items() for k, v in {"n": one(e.isNotNull()), "rows_gt_50": one(e > 50), "rows_gt_100": one(e > 100)}.items()}
    out = metrics.segment_means(p, FAMILIES, LEVELS, [], totals, {f"mae_{m}": e for m, e in errors.items()}).drop("n")
    return _stacked(out, ["segment_type", "segment"], {m: {"model": m} for m in "abc"}, ["n", "rows_gt_50", "rows_gt_100", "mae"]).select("model", "segment_type", "segment", "n", "rows_gt_50", "rows_gt_100", _r("mae", 8))


_DAILY_SQL = "daily AS (SELECT region_id, utc_day, count(*) AS k, sum(abs(c - observed)) AS s, sum(c - observed) AS t, sum(CASE WHEN abs(c - observed) > 50 THEN 1.0 ELSE 0 END) AS g FROM predicted WHERE c IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {PREDICTED_SQL}, {_DAILY_SQL} SELECT region_id, CAST(sum(k) AS BIGINT) AS rows, count(*) AS dates, round(avg(s / k), 6) AS date_mae, round(avg(t / k), 6) AS date_bias, round(avg(g / k), 6) AS date_gt50, round(sum(s) / sum(k), 6) AS pixel_mae, round(sum(t) / sum(k), 6) AS pixel_bias, round(sum(g) / sum(k), 6) AS pixel_gt50 FROM daily GROUP BY region_id")
def agg_05_date_balanced(spark: SparkSession, d: str) -> DataFrame:
    e = predicted(spark, d).withColumn("e", F.col("c") - F.col("observed"))
    return metrics.date_balanced(e, ["region_id"], "utc_day", "e", [50]).select("region_id", "rows", "dates", *(_r(f"{a}_{b}") for a in ("date", "pixel") for b in ("mae", "bias", "gt50")))


_LEAK_SQL = """held AS (SELECT *, CASE WHEN utc_day < DATE '1997-01-01' THEN 'early' ELSE 'late' END AS fit, CASE WHEN phase = 'F' THEN 'date_holdout' WHEN phase = 'O' THEN 'region_holdout' ELSE 'spatial' END AS kind FROM predicted),
members AS (SELECT 'early' AS fit, sample_id, month, region_id FROM samples WHERE utc_day >= DATE '1996-12-10' AND acquisition_id % 7 = 0 UNION ALL SELECT 'late', sample_id, month, region_id FROM samples WHERE utc_day < DATE '1997-02-01' AND acquisition_id % 5 = 0 AND region_id < 'M'),
leaks AS (SELECT held.*, (EXISTS (SELECT 1 FROM members m WHERE m.fit = held.fit AND m.sample_id = held.sample_id) OR (kind = 'date_holdout' AND (held.fit, held.month) IN (SELECT fit, month FROM members))
  OR (kind = 'region_holdout' AND (held.fit, held.region_id) IN (SELECT fit, region_id FROM members))) AS leaked FROM held)"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    p = written(predicted(spark, d), "predicted")  # read for the held rows and for both memberships
    held = p.withColumn("fit", F.when(F.col("utc_day") < F.to_date(F.lit("1997-01-01")), "early").otherwise("late")).withColumn("kind", F.when(F.col("phase") == "F", "date_holdout").when(F.col("phase") == "O", "region_holdout").otherwise("spatial"))
    s = p
    early = s.filter((F.col("utc_day") >= F.to_date(F.lit("1996-12-10"))) & (F.col("acquisition_id") % 7 == 0)).withColumn("fit", F.lit("early"))
    late = s.filter((F.col("utc_day") < F.to_date(F.lit("1997-02-01"))) & (F.col("acquisition_id") % 5 == 0) & (F.col("region_id") < "M")).withColumn("fit", F.lit("late"))
    members = written(early.unionByName(late).select("fit", "sample_id", "month", "region_id"), "members")
    return joins.leakage(held, members, "fit", "sample_id", "month", "region_id", "kind")


@query(f"WITH {PREDICTED_SQL}, {_LEAK_SQL} SELECT fit, kind, count(*) AS n, count(*) FILTER (WHERE leaked) AS leaked_rows FROM leaks GROUP BY fit, kind")
def jn_12_leakage(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("fit", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaked_rows"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Every region in each of four phases; the last phase has no rows."""
    return load(spark, d, "nation").select(F.col("n_name").alias("region_id"), F.explode(F.array(*map(F.lit, "FOPN"))).alias("phase"))


_REGISTRY_SQL = "registry AS (SELECT n_name AS region_id, unnest(['F', 'O', 'P', 'N']) AS phase FROM nation)"


@query(f"WITH {PREDICTED_SQL}, {_REGISTRY_SQL}, o AS (SELECT region_id, phase, count(*) AS n, round(avg(abs(a - observed)), 6) AS mae FROM predicted GROUP BY 1, 2) SELECT region_id, phase, coalesce(n, 0) AS n, mae FROM registry LEFT JOIN o USING (region_id, phase)")
def jn_13_registry_outer(spark: SparkSession, d: str) -> DataFrame:
    observed = predicted(spark, d).groupBy("region_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("observed"))), 6).alias("mae"))
    return joins.registry_outer(registry(spark, d), observed, ["region_id", "phase"], ["n"])


_Q = ", ".join(f"count(DISTINCT utc_day) FILTER (WHERE quarter = {q}) AS q{q}_dates" for q in range(1, 5))


@query(f"""WITH {PREDICTED_SQL}, {_LEAK_SQL}, {_REGISTRY_SQL},
x AS (SELECT *, c - observed AS e FROM leaks),
cnt AS (SELECT region_id, phase, count(*) AS reference_rows, count(e) AS predicted_rows, count(DISTINCT utc_day) AS independent_dates, max(CAST(leaked AS INT)) AS lk, {_Q} FROM x GROUP BY 1, 2),
dy AS (SELECT region_id, phase, quarter, utc_day, count(*) AS k, sum(abs(e)) AS s, sum(e) AS t FROM x WHERE e IS NOT NULL GROUP BY 1, 2, 3, 4),
st AS (SELECT region_id, phase, avg(s / k) AS date_mae, sum(s) / sum(k) AS pixel_mae, avg(t / k) AS date_bias FROM dy GROUP BY 1, 2),
qs AS (SELECT region_id, phase, quarter, avg(s / k) AS dm, sum(s) / sum(k) AS pm FROM dy GROUP BY 1, 2, 3),
ql AS (SELECT region_id, phase, list_sort(list('quarter_' || quarter || '_mae_target_failed')) AS late FROM qs WHERE dm > 60 OR pm > 60 GROUP BY 1, 2),
j AS (SELECT registry.region_id, registry.phase, coalesce(reference_rows, 0) AS reference_rows, coalesce(predicted_rows, 0) AS predicted_rows, coalesce(independent_dates, 0) AS independent_dates, coalesce(lk, 0) AS lk,
  coalesce(q1_dates, 0) AS q1_dates, coalesce(q2_dates, 0) AS q2_dates, coalesce(q3_dates, 0) AS q3_dates, coalesce(q4_dates, 0) AS q4_dates, date_mae, pixel_mae, date_bias, coalesce(late, []) AS late
  FROM registry LEFT JOIN cnt USING (region_id, phase) LEFT JOIN st USING (region_id, phase) LEFT JOIN ql USING (region_id, phase)),
p AS (SELECT *, coalesce(reference_rows > 0 AND predicted_rows = reference_rows AND date_mae <= 60 AND pixel_mae <= 60, false) AS point_target_met FROM j),
r AS (SELECT *, list_concat(list_filter([CASE WHEN reference_rows = 0 THEN 'missing_group' END, CASE WHEN reference_rows < 100 THEN 'insufficient_reference_rows' END, CASE WHEN independent_dates < 12 THEN 'insufficient_independent_dates' END,
  CASE WHEN least(q1_dates, q2_dates, q3_dates, q4_dates) < 3 THEN 'insufficient_seasonal_dates' END, CASE WHEN predicted_rows <> reference_rows THEN 'missing_predictions' END, CASE WHEN lk = 1 THEN 'training_overlap' END,
  CASE WHEN reference_rows > 0 AND NOT point_target_met THEN 'mae_target_or_coverage_failed' END], lambda v: v IS NOT NULL), late) AS rs FROM p)
SELECT region_id, phase, reference_rows, predicted_rows, independent_dates, q1_dates, q2_dates, q3_dates, q4_dates, round(date_mae, 6) AS date_mae, round(pixel_mae, 6) AS pixel_mae, round(date_bias, 6) AS date_bias,
  round(CASE WHEN reference_rows > 0 THEN predicted_rows / reference_rows ELSE 0.0 END, 6) AS prediction_coverage, point_target_met, array_to_string(rs, ';') AS reasons, len(rs) = 0 AS passed FROM r""")
def agg_06_acceptance(spark: SparkSession, d: str) -> DataFrame:
    rows = _leaks(spark, d).withColumn("e", F.col("c") - F.col("observed"))
    out = metrics.acceptance(rows, registry(spark, d), ["region_id", "phase"], "utc_day", "quarter", "e", "leaked", target=60, min_rows=100, min_dates=12, min_quarter_dates=3)
    return out.select("region_id", "phase", "reference_rows", "predicted_rows", "independent_dates", *(f"q{q}_dates" for q in range(1, 5)), *(_r(c) for c in ("date_mae", "pixel_mae", "date_bias", "prediction_coverage")), "point_target_met", "reasons", "passed")


@query(f"""WITH {PREDICTED_SQL}, {_LONG_SQL}, v AS (SELECT 'own' AS view, * FROM long WHERE e IS NOT NULL UNION ALL SELECT 'matched', * FROM long WHERE sample_id IN (SELECT sample_id FROM predicted WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)),
{_weights_sql('v', 'view, model, region_id')}, s AS (SELECT view, model, region_id, count(*) AS n, round(sum(weight * abs(e)), 8) AS mae FROM w GROUP BY ALL),
reg AS (SELECT n_name AS region_id, v AS view, m AS model FROM nation, (SELECT unnest(['own', 'matched']) AS v), (SELECT unnest(['a', 'b', 'c']) AS m) UNION ALL SELECT 'NOWHERE', v, m FROM (SELECT unnest(['own', 'matched']) AS v), (SELECT unnest(['a', 'b', 'c']) AS m))
SELECT view, model, region_id, coalesce(n, 0) AS n, mae FROM reg LEFT JOIN s USING (view, model, region_id)""")
def agg_07_matched_and_own(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d)
    errors = {m: F.abs(F.col(m) - F.col("observed")) for m in "abc"}
    all_three = F.greatest(*(F.when(e.isNull(), 1).otherwise(0) for e in errors.values())) == 0
    kinds = {f"{view}_{m}": {"view": view, "model": m} for view in ("own", "matched") for m in "abc"}  # side by side: no row is copied
    means = {f"mae_{name}": errors[k["model"]] if k["view"] == "own" else F.when(all_three, errors[k["model"]]) for name, k in kinds.items()}
    totals = {f"n_{name}": F.when(means[f"mae_{name}"].isNotNull(), 1).otherwise(0) for name in kinds}
    by_region = metrics.segment_means(p, {"by_region": ["region_id"]}, LEVELS, ["region_id"], totals, means).drop("n")
    keys = ["view", "model", "region_id"]
    scores = _stacked(by_region, ["region_id"], kinds, ["n", "mae"]).select(*keys, "n", _r("mae", 8))
    names = load(spark, d, "nation").select(F.col("n_name").alias("region_id")).union(spark.range(1).select(F.lit("NOWHERE")))
    required = names.withColumn("view", F.explode(F.array(F.lit("own"), F.lit("matched")))).withColumn("model", F.explode(F.array(*map(F.lit, "abc"))))
    return joins.registry_outer(required, scores, keys, ["n"]).select("view", "model", "region_id", "n", "mae")


@query(f"WITH {PREDICTED_SQL} SELECT phase, round(avg(CASE WHEN observed BETWEEN b - 40 AND c + 40 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(c + 40 - (b - 40)), 6) AS mean_width, count(*) AS n FROM predicted WHERE b IS NOT NULL GROUP BY phase")
def agg_08_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("b IS NOT NULL").withColumns({"low": F.col("b") - 40, "high": F.col("c") + 40})
    return metrics.interval_coverage(p, ["phase"], "observed", "low", "high").select("phase", _r("coverage"), _r("mean_width"), "n")


@query(f"WITH {PREDICTED_SQL}, k AS (SELECT region_id, abs(a - observed) AS r, row_number() OVER (PARTITION BY region_id ORDER BY abs(a - observed)) AS k, count(*) OVER (PARTITION BY region_id) AS n FROM predicted WHERE a IS NOT NULL) SELECT region_id, n, CAST(ceil((n + 1) * 0.9) AS BIGINT) AS rank, round(max(CASE WHEN k = ceil((n + 1) * 0.9) THEN r END), 6) AS radius FROM k GROUP BY region_id, n")
def agg_09_order_radius(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("a IS NOT NULL").withColumn("e", F.col("a") - F.col("observed"))
    return metrics.order_radius(p, ["region_id"], "e", 0.9).select("region_id", "n", "rank", _r("radius"))


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, a - observed AS e FROM predicted WHERE a IS NOT NULL), {_weights_sql('ok', 'phase')}, k AS (SELECT phase, abs(e) AS r, sum(weight) OVER (PARTITION BY phase ORDER BY abs(e), sample_id ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY phase) AS total FROM w) SELECT phase, round(coalesce(min(CASE WHEN run >= 0.9 * total - 1e-12 THEN r END), max(r)), 6) AS radius FROM k GROUP BY phase")
def agg_10_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    ok = predicted(spark, d).filter("a IS NOT NULL").withColumn("e", F.col("a") - F.col("observed"))
    return metrics.weighted_quantile_radius(windows.balanced_weights(ok, LEVELS, ["phase"]), ["phase"], "e", "weight", 0.9).select("phase", _r("radius"))


@query(f"WITH {PREDICTED_SQL}, b0 AS (SELECT region_id, utc_day, sqrt(avg((c - observed) * (c - observed))) AS rmse FROM predicted WHERE c IS NOT NULL GROUP BY 1, 2) SELECT region_id, count(*) AS blocks, round(avg(rmse), 6) AS mean, round(quantile_cont(rmse, 0.5), 6) AS median, round(quantile_cont(rmse, 0.9), 6) AS p90 FROM b0 GROUP BY region_id")
def agg_11_block_rmse(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("c") - F.col("observed")
    blocks = predicted(spark, d).filter("c IS NOT NULL").groupBy("region_id", "utc_day").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return blocks.groupBy("region_id").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("rmse"), 6).alias("mean"), F.round(F.percentile("rmse", 0.5), 6).alias("median"), F.round(F.percentile("rmse", 0.9), 6).alias("p90"))


_SEASON_SQL = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) <= 5 THEN 'MAM' WHEN month(ts) <= 8 THEN 'JJA' ELSE 'SON' END"


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, count(*) AS rows, count(DISTINCT utc_day) AS dates, count(DISTINCT acquisition_id) AS acquisitions, count(DISTINCT CASE WHEN utc_day >= DATE '1999-01-01' THEN utc_day END) AS new_dates, count(DISTINCT product) AS blocks, array_to_string(list_sort(list(DISTINCT {_SEASON_SQL})), ',') AS seasons FROM samples GROUP BY 1, 2")
def agg_12_support_counts(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("season", season(F.col("ts")))
    return metrics.support_counts(s, ["region_id", "phase"], "utc_day", "acquisition_id", F.col("utc_day") >= F.to_date(F.lit("1999-01-01")), "product", "season")


@query(f"WITH {SAMPLES_SQL}, {_weights_sql('samples')}, m AS (SELECT utc_day, sum(weight) AS m FROM w GROUP BY 1) SELECT round(pow(sum(m), 2) / sum(m * m), 4) AS effective_dates FROM m")
def agg_13_effective_dates(spark: SparkSession, d: str) -> DataFrame:
    return windows.effective_dates(windows.balanced_weights(samples(spark, d), LEVELS), "weight", "utc_day").select(F.round("effective_dates", 4).alias("effective_dates"))


@query(f"WITH {SAMPLES_SQL}, x AS (SELECT substr(region_id, 1, 1) AS letter, phase, count(DISTINCT utc_day) AS dates, count(DISTINCT month) AS months, count(DISTINCT ((year(ts) - 1995) * 12 + month(ts) - 1) % 3) AS folds FROM samples GROUP BY 1, 2) SELECT *, dates >= 1900 AND months >= 3 AND folds >= 2 AS supported FROM x")
def agg_14_group_support(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumns({"letter": F.substring("region_id", 1, 1), "fold": month_fold(F.col("ts"), 1995)})
    return metrics.group_support(s, ["letter", "phase"], "utc_day", "month", "fold", min_dates=1900)


@query()
def agg_15_date_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Drawn by hash; tested by its invariants."""
    daily = predicted(spark, d).filter("a IS NOT NULL").groupBy("utc_day").agg(F.sum(F.abs(F.col("b") - F.col("observed")) - F.abs(F.col("a") - F.col("observed"))).alias("b_less_a"), F.sum(F.abs(F.col("c") - F.col("observed")) - F.abs(F.col("a") - F.col("observed"))).alias("c_less_a"), F.count(F.lit(1)).alias("n"))
    return metrics.bootstrap(daily, "utc_day", ["b_less_a", "c_less_a"], "n", draws=200, seed=2708)


_ARM_SQL = f"WITH {PREDICTED_SQL}, {_LONG_SQL}, m AS (SELECT region_id, model, avg(abs(e)) AS mae FROM long WHERE e IS NOT NULL GROUP BY 1, 2), p AS (SELECT region_id, max(CASE WHEN model = 'a' THEN mae END) AS baseline, max(CASE WHEN model = 'c' THEN mae END) AS candidate FROM m GROUP BY 1)"
_OUTCOME = "CASE WHEN candidate - baseline IS NULL THEN 'missing' WHEN candidate - baseline < -1e-9 THEN 'improved' WHEN candidate - baseline > 1e-9 THEN 'worsened' ELSE 'unchanged' END"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    m = _long(spark, d).filter("e IS NOT NULL").groupBy("region_id", "model").agg(F.avg(F.abs("e")).alias("mae"))
    return joins.paired_arms(m, ["region_id"], "model", "mae", "a", "c")


@query(f"{_ARM_SQL} SELECT region_id, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(candidate - baseline, 6) AS delta, {_OUTCOME} AS outcome FROM p")
def jn_14_paired_arms(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("region_id", *(_r(c) for c in ("baseline", "candidate", "delta")), "outcome")


@query(f"{_ARM_SQL} SELECT {_OUTCOME} AS outcome, count(*) AS regions, count(*) FILTER (WHERE candidate <= 50) AS within_50 FROM p GROUP BY 1")
def agg_31_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("candidate") <= 50).alias("within_50"))


@query(f"WITH {PREDICTED_SQL} SELECT phase, count(*) AS n, round(avg(abs(c - observed) - abs(a - observed)), 6) AS mean_delta, count(*) FILTER (WHERE abs(c - observed) < abs(a - observed)) AS better FROM predicted WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY phase")
def agg_16_paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    delta = F.abs(F.col("c") - F.col("observed")) - F.abs(F.col("a") - F.col("observed"))
    return predicted(spark, d).filter("a IS NOT NULL AND c IS NOT NULL").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"), F.count_if(delta < 0).alias("better"))


@query(f"WITH {PREDICTED_SQL} SELECT region_id, round(avg(CASE WHEN observed >= 250 THEN abs(c - observed) END), 6) AS hot_mae, round(avg(CASE WHEN observed <= 50 THEN abs(c - observed) END), 6) AS cold_mae, round(quantile_cont(abs(c - observed), 0.9), 6) AS p90_abs_error, count(c) AS n FROM predicted GROUP BY region_id")
def agg_17_tail_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).withColumn("e", F.col("c") - F.col("observed"))
    return metrics.tail_metrics(p, ["region_id"], "observed", "e", 250, 50).select("region_id", _r("hot_mae"), _r("cold_mae"), _r("p90_abs_error"), "n")


@query(f"WITH {SAMPLES_SQL} SELECT 'region_phase' AS dimension, region_id || '|' || phase AS member, count(*) AS original_rows, count(*) FILTER (WHERE observed > 150) AS retained_rows, count(DISTINCT utc_day) AS original_dates, count(DISTINCT CASE WHEN observed > 150 THEN utc_day END) AS retained_dates, count(*) FILTER (WHERE observed > 150) = 0 AS lost_support FROM samples GROUP BY region_id, phase UNION ALL SELECT 'month', month, count(*), count(*) FILTER (WHERE observed > 150), count(DISTINCT utc_day), count(DISTINCT CASE WHEN observed > 150 THEN utc_day END), count(*) FILTER (WHERE observed > 150) = 0 FROM samples GROUP BY month UNION ALL SELECT 'acquisition', CAST(acquisition_id AS VARCHAR), count(*), count(*) FILTER (WHERE observed > 150), count(DISTINCT utc_day), count(DISTINCT CASE WHEN observed > 150 THEN utc_day END), count(*) FILTER (WHERE observed > 150) = 0 FROM samples GROUP BY acquisition_id")
def agg_19_availability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.availability(samples(spark, d), {"region_phase": ["region_id", "phase"], "month": ["month"], "acquisition": ["acquisition_id"]}, F.col("observed") > 150, "utc_day")


@query(f"WITH {PREDICTED_SQL} SELECT product, phase, count(*) AS n, count(c) AS supported, count(*) - count(c) AS fallback, round(avg(abs(c - b)), 6) AS mean_change, round(max(abs(c - b)), 6) AS max_change, round(quantile_cont(c - b, 0.5), 6) AS median_change, round(stddev_samp(c - b), 6) AS sd_change FROM predicted GROUP BY 1, 2")
def agg_20_usage_report(spark: SparkSession, d: str) -> DataFrame:
    change = F.col("c") - F.col("b")
    return predicted(spark, d).groupBy("product", "phase").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("supported"), F.count_if(F.col("c").isNull()).alias("fallback"), F.round(F.avg(F.abs(change)), 6).alias("mean_change"), F.round(F.max(F.abs(change)), 6).alias("max_change"), F.round(F.percentile(change, 0.5), 6).alias("median_change"), F.round(F.stddev_samp(change), 6).alias("sd_change"))


@query("SELECT f AS feature, lo AS min, hi AS max, round(me, 6) AS mean, mi AS missing FROM (SELECT 'l_quantity' AS f, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS me, count(*) FILTER (WHERE l_quantity IS NULL) AS mi FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), avg(l_extendedprice), count(*) FILTER (WHERE l_extendedprice IS NULL) FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), avg(l_tax), count(*) FILTER (WHERE l_tax IS NULL) FROM lineitem)")
def agg_26_feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feature_summary(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("feature", "min", "max", _r("mean"), "missing")


@query(f"""WITH {SAMPLES_SQL}, i AS (SELECT acquisition_id, utc_day AS s, utc_day + CAST(sample_id % 60 AS INT) AS e FROM samples), g AS (SELECT *, max(e) OVER (PARTITION BY acquisition_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT acquisition_id, CAST(CAST(reach + 1 AS DATE) AS VARCHAR) AS gap_start, CAST(CAST(s - 1 AS DATE) AS VARCHAR) AS gap_end FROM g WHERE s > reach + 1""")
def agg_27_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    i = samples(spark, d).select("acquisition_id", F.col("utc_day").alias("s"), F.date_add("utc_day", F.col("sample_id").cast("int") % 60).alias("e"))
    return windows.coverage_gaps(i, ["acquisition_id"], "s", "e").select("acquisition_id", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"))


@query(f"WITH {SAMPLES_SQL} SELECT region_id, phase, sha256(array_to_string(list_sort(list(CAST(sample_id AS VARCHAR))), chr(10))) AS sha256 FROM samples GROUP BY 1, 2")
def agg_28_exact_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("region_id", "phase", F.col("sample_id").cast("string").alias("sample_id"))
    return digests.ordered_digest(rows, ["region_id", "phase"], "sample_id", "\n")


@query(f"WITH {SAMPLES_SQL}, two AS (SELECT region_id, phase, product, count(*) AS n FROM samples GROUP BY 1, 2, 3) SELECT region_id, CAST(sum(n) AS BIGINT) AS rows, array_to_string(list_sort(list(phase || '/' || product || '=' || n)), ',') AS sources FROM two GROUP BY 1")
def agg_30_nested_counts(spark: SparkSession, d: str) -> DataFrame:
    two = samples(spark, d).groupBy("region_id", "phase", "product").agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy("region_id").agg(F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list(F.concat("phase", F.lit("/"), "product", F.lit("="), F.col("n").cast("string")))), ",").alias("sources"))


@query(f"WITH {SAMPLES_SQL}, c AS (SELECT region_id, utc_day, count(*) FILTER (WHERE k >= 2) AS blocks, sum(k) AS cells FROM (SELECT region_id, utc_day, surface, count(*) AS k FROM samples GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT region_id, count(*) FILTER (WHERE blocks >= 1 AND cells >= 3) AS qualifying_dates, count(*) AS dates FROM c GROUP BY region_id")
def agg_32_qualifying_dates(spark: SparkSession, d: str) -> DataFrame:
    blocks = samples(spark, d).groupBy("region_id", "utc_day", "surface").agg(F.count(F.lit(1)).alias("k"))
    days = blocks.groupBy("region_id", "utc_day").agg(F.count_if(F.col("k") >= 2).alias("blocks"), F.sum("k").alias("cells"))
    return days.groupBy("region_id").agg(F.count_if((F.col("blocks") >= 1) & (F.col("cells") >= 3)).alias("qualifying_dates"), F.count(F.lit(1)).alias("dates"))


@query(f"""WITH {SAMPLES_SQL}, o AS (SELECT region_id, count(*) AS old_rows, count(DISTINCT utc_day) AS old_dates FROM samples WHERE utc_day < DATE '1998-01-01' GROUP BY 1), n AS (SELECT region_id, count(*) AS new_rows, count(DISTINCT utc_day) AS new_dates FROM samples GROUP BY 1)
SELECT region_id, coalesce(old_rows, 0) AS old_rows, new_rows, coalesce(old_dates, 0) AS old_dates, new_dates, coalesce(old_rows, 0) > new_rows AS shrunk FROM n FULL JOIN o USING (region_id)""")
def agg_33_coverage_before_after(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    count = lambda df, name: df.groupBy("region_id").agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.count_distinct("utc_day").alias(f"{name}_dates"))
    both = count(s.filter(F.col("utc_day") < F.to_date(F.lit("1998-01-01"))), "old").join(count(s, "new"), "region_id", "full_outer").na.fill(0)
    return both.select("region_id", "old_rows", "new_rows", "old_dates", "new_dates", (F.col("old_rows") > F.col("new_rows")).alias("shrunk"))


@query(f"WITH {PREDICTED_SQL}, x AS (SELECT *, CASE WHEN observed > 150 THEN 'retained' ELSE 'excluded' END AS coverage FROM predicted WHERE c IS NOT NULL) SELECT coverage, phase, count(*) AS n, round(avg(abs(c - observed)), 6) AS mae, round(sqrt(avg((c - observed) * (c - observed))), 6) AS rmse, round(avg(c - observed), 6) AS bias FROM x GROUP BY 1, 2")
def agg_35_retained_and_excluded(spark: SparkSession, d: str) -> DataFrame:
    x = predicted(spark, d).filter("c IS NOT NULL").withColumn("coverage", F.when(F.col("observed") > 150, "retained").otherwise("excluded"))
    return x.groupBy("coverage", "phase").agg(*metrics.error_metrics(F.col("c") - F.col("observed"))).select("coverage", "phase", "n", _r("mae"), _r("rmse"), _r("bias"))


@query(f"""WITH {PREDICTED_SQL}, ok AS (SELECT *, b - a AS d, b - observed AS e FROM predicted WHERE a IS NOT NULL), {_weights_sql('ok')}, y AS (SELECT phase, utc_day, sum(weight) AS m, sum(weight * d * e) AS de, sum(weight * d * d) AS dd, count(*) AS k FROM w GROUP BY 1, 2),
g AS (SELECT phase, sum(m) AS m, sum(m * m) AS mm, sum(de) AS de, sum(dd) AS dd, count(*) AS dates, CAST(sum(k) AS BIGINT) AS rows FROM y GROUP BY 1), z AS (SELECT *, m * m / mm AS n FROM g)
SELECT phase, rows, dates, round(n, 4) AS effective_dates, round((n * de / m) / (n * dd / m + 20), 6) AS unbounded_gamma, round(CASE WHEN dates >= 6 THEN greatest(0, least(1, (n * de / m) / (n * dd / m + 20))) ELSE 0 END, 6) AS gamma, CASE WHEN dates >= 6 THEN 'fitted' ELSE 'unsupported_identity_fallback' END AS status FROM z""")
def ml_05_scalar_shrink(spark: SparkSession, d: str) -> DataFrame:
    columns = ["region_id", "phase", "utc_day", "acquisition_id", "surface", "a", "b", "observed"]
    rows = written(predicted(spark, d).filter("a IS NOT NULL").select(columns), "predicted")  # read for the leaves and for the sums
    ok = windows.balanced_weights(rows, LEVELS)
    return estimate.scalar_shrink(ok, ["phase"], "weight", F.col("b") - F.col("a"), F.col("b") - F.col("observed"), "utc_day").select("phase", "rows", "dates", F.round("effective_dates", 4).alias("effective_dates"), _r("unbounded_gamma"), _r("gamma"), "status")


@query(f"""{_ARM_SQL}, g AS (SELECT *, CASE WHEN candidate > baseline + 1 THEN 'overall_regression' WHEN candidate > 60 THEN 'target_missed' END AS rejected_for FROM p) SELECT region_id, rejected_for, rejected_for IS NULL AS accepted FROM g""")
def ml_12_gates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gate(_paired(spark, d), [(F.col("candidate") > F.col("baseline") + 1, "overall_regression"), (F.col("candidate") > 60, "target_missed")]).select("region_id", "rejected_for", "accepted")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Balanced-weight score card of every required region and phase."""
    ok = predicted(spark, d).filter("c IS NOT NULL").withColumn("e", F.col("c") - F.col("observed"))
    scores = _scored(ok, ["region_id", "phase"])
    return joins.registry_outer(registry(spark, d), scores, ["region_id", "phase"], ["n", "date_count", "acquisition_count"])
