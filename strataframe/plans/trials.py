"""Split trials: many fits over the samples, with memberships by exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import trials
from ..session import load
from ..store import written
from .registry import query
from .views import PREDICTED_SQL, SAMPLES_SQL, predicted, samples

#: Months that are held one at a time; the last has no sample, so its fit has the recipe of the full one.
MONTHS = [f"{y}-{m:02d}" for y, last in ((1996, 12), (1997, 6)) for m in range(1, last + 1)] + ["2030-01"]
REFERENCE = "NATION_0"
FEATURES = ("1.0", "a / 100", "balance / 10000")


def solve_sql(alpha: float) -> list[str]:
    """Cramer's rule for systems of three features whose sums are m0 to m8."""
    a, b, c, d, e, f, r, s, t = f"(m0 + {alpha})", "m1", "m2", f"(m3 + {alpha})", "m4", f"(m5 + {alpha})", "m6", "m7", "m8"
    three = lambda x: f"({x[0]} * ({x[4]} * {x[8]} - {x[5]} * {x[7]}) - {x[1]} * ({x[3]} * {x[8]} - {x[5]} * {x[6]}) + {x[2]} * ({x[3]} * {x[7]} - {x[4]} * {x[6]}))"
    whole = three([a, b, c, b, d, e, c, e, f])
    return [f"{three(m)} / {whole}" for m in ([r, b, c, s, d, e, t, e, f], [a, r, c, b, s, e, c, t, f], [a, b, r, b, d, s, c, e, t])]


def sums_sql(target: str, weight: str = "1.0") -> str:
    p = len(FEATURES)
    products = [f"{FEATURES[i]} * {FEATURES[j]}" for i in range(p) for j in range(i, p)] + [f"{x} * ({target})" for x in FEATURES]
    return ", ".join(f"sum({weight} * {x}) AS m{k}" for k, x in enumerate(products))


def features() -> list[Column]:
    return [F.lit(1.0), F.col("a") / 100, F.col("balance") / 10000]


SUMS = [f"m{k}" for k in range(9)]
COEFFICIENTS = ", ".join(f"{x} AS c{k}" for k, x in enumerate(solve_sql(1.0)))
PREDICTION = f"c0 + c1 * ({FEATURES[1]}) + c2 * ({FEATURES[2]})"


# fits by group and by fold, in one pass


_FOLD = "CAST(((year(ts) - 1995) * 12 + month(ts) - 1) % 3 AS INT)"


@query(f"""WITH {PREDICTED_SQL}, r AS (SELECT *, {_FOLD} AS fold FROM predicted WHERE a IS NOT NULL), k AS (SELECT DISTINCT fold AS out FROM r), s AS (SELECT out, {sums_sql("observed")} FROM k JOIN r ON fold <> out GROUP BY 1), c AS (SELECT out, {COEFFICIENTS} FROM s)
SELECT sample_id, fold, round({PREDICTION}, 5) AS oof_prediction FROM r JOIN c ON out = fold""")
def ml_03_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d).filter("a IS NOT NULL").withColumn("fold", E.month_fold(F.col("ts"), 1995).cast("int"))
    oof = trials.out_of_fold(rows, "fold", features(), F.col("observed"), F.lit(1.0), 1.0)
    return oof.select("sample_id", "fold", F.round("oof_prediction", 5).alias("oof_prediction"))


@query(f"""WITH {PREDICTED_SQL}, r AS (SELECT * FROM predicted WHERE a IS NOT NULL), g AS (SELECT product, count(DISTINCT utc_day) AS dates, {sums_sql("observed")} FROM r GROUP BY 1), own AS (SELECT product, {COEFFICIENTS} FROM g WHERE dates >= 100 AND product <> 'MACHINERY'),
w AS (SELECT {sums_sql("observed")} FROM r), shared AS (SELECT {COEFFICIENTS} FROM w)
SELECT sample_id, product AS route, round({PREDICTION}, 5) AS routed_prediction FROM r JOIN own USING (product) UNION ALL SELECT sample_id, 'shared', round({PREDICTION}, 5) FROM r, shared WHERE product NOT IN (SELECT product FROM own)""")
def ml_08_group_experts(spark: SparkSession, d: str) -> DataFrame:
    """A product's own fit where it has 100 dates, the shared fit for the others and for a product that is kept out."""
    rows = predicted(spark, d).filter("a IS NOT NULL")
    able = (F.col("dates") >= 100) & (F.col("product") != "MACHINERY")
    routed = trials.experts(rows, "product", able, features(), F.col("observed"), F.lit(1.0), 1.0, [F.count_distinct("utc_day").alias("dates")])
    return routed.select("sample_id", "route", F.round("routed_prediction", 5).alias("routed_prediction"))


# memberships by exclusion


_MID = "strftime(ts + INTERVAL 1 DAY, '%Y-%m')"
_ROWS_SQL = f"{PREDICTED_SQL}, g AS (SELECT *, acquisition_id // 5 AS granule, month AS m0, {_MID} AS mid, strftime(ts + INTERVAL 2 DAY, '%Y-%m') AS m1, 1.0 + sample_id % 7 AS area FROM predicted WHERE a IS NOT NULL)"
_CATALOGUE_SQL = f"cat AS (SELECT CASE WHEN n_name = '{REFERENCE}' THEN 'reference' ELSE 'pilot' END AS mode, n_name AS key FROM nation UNION ALL SELECT 'month', unnest({MONTHS}) UNION ALL SELECT 'full', 'all')"
_EXCLUDED_SQL = "x AS (SELECT DISTINCT mode, key, granule FROM g JOIN cat ON mode IN ('pilot', 'reference') AND region_id = key UNION SELECT DISTINCT mode, key, granule FROM g JOIN cat ON mode = 'month' AND (m0 = key OR m1 = key))"
_HELD_SQL = f"h AS (SELECT mode, key, g.* FROM g JOIN cat ON mode IN ('pilot', 'reference') AND region_id = key UNION ALL SELECT mode, key, g.* FROM g JOIN cat ON mode = 'month' AND mid = key WHERE region_id <> '{REFERENCE}')"


def observed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a prediction: the granule that five neighbouring acquisitions share, the months it spans, and an area. Written,
    as memberships, fits and scores read them."""
    month = lambda days: F.date_format(F.col("ts") + F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM")
    rows = predicted(spark, d).filter("a IS NOT NULL").withColumns({"granule": F.expr("acquisition_id div 5"), "m0": F.col("month"), "mid": month(1), "m1": month(2), "area": 1.0 + F.col("sample_id") % 7})
    return written(rows.select("sample_id", "region_id", "phase", "utc_day", "acquisition_id", "granule", "m0", "mid", "m1", "area", "a", "balance", "observed"), "rows")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    regions = load(spark, d, "nation").select(F.when(F.col("n_name") == REFERENCE, "reference").otherwise("pilot").alias("mode"), F.col("n_name").alias("key"))
    return regions.union(spark.createDataFrame([("month", m) for m in MONTHS] + [("full", "all")], "mode string, key string"))


@query(f"""WITH {_ROWS_SQL}, {_CATALOGUE_SQL}, {_EXCLUDED_SQL}, {_HELD_SQL}
SELECT mode, key, 'held' AS role, count(*) AS n FROM h GROUP BY 1, 2
UNION ALL SELECT mode, key, 'train', (SELECT count(*) FROM g WHERE region_id <> '{REFERENCE}' AND NOT EXISTS (SELECT 1 FROM x WHERE x.mode = cat.mode AND x.key = cat.key AND x.granule = g.granule)) FROM cat""")
def spl_05_memberships(spark: SparkSession, d: str) -> DataFrame:
    """All 45 fits, the full one and one without any exclusion among them: the train side is known by what it leaves out."""
    rows, cat = observed_rows(spark, d), catalogue(spark, d)
    excluded = trials.exclusions(rows, cat, "granule", "region_id", "m0", "m1")
    train = trials.train_counts(rows.filter(F.col("region_id") != REFERENCE), cat, excluded, "granule").select("mode", "key", F.lit("train").alias("role"), "n")
    held = trials.held_rows(rows, cat, "region_id", "mid", [REFERENCE]).groupBy("mode", "key").agg(F.count(F.lit(1)).alias("n")).select("mode", "key", F.lit("held").alias("role"), "n")
    return train.union(held)


_MEANS = ", ".join(f"avg({m}) AS {m}" for m in SUMS)


@query(f"""WITH {_ROWS_SQL}, {_CATALOGUE_SQL}, {_EXCLUDED_SQL}, {_HELD_SQL},
f AS (SELECT cat.mode, cat.key, arm, g.* FROM g, cat, (SELECT unnest(['old_only', 'expanded']) AS arm) WHERE region_id <> '{REFERENCE}' AND (arm = 'expanded' OR utc_day < DATE '1998-01-01') AND NOT EXISTS (SELECT 1 FROM x WHERE x.mode = cat.mode AND x.key = cat.key AND x.granule = g.granule)),
n AS (SELECT mode, key, arm, count(*) AS rows, count(DISTINCT region_id) AS regions, count(DISTINCT utc_day) AS dates, bit_xor(hash(sample_id)) AS digest FROM f GROUP BY 1, 2, 3),
acq AS (SELECT mode, key, arm, region_id, phase, utc_day, acquisition_id, sum(area) AS total, {sums_sql("observed - a", "area")} FROM f GROUP BY 1, 2, 3, 4, 5, 6, 7),
day AS (SELECT mode, key, arm, region_id, phase, utc_day, {", ".join(f"avg({m} / total) AS {m}" for m in SUMS)} FROM acq GROUP BY 1, 2, 3, 4, 5, 6),
grp AS (SELECT mode, key, arm, region_id, phase, {_MEANS} FROM day GROUP BY 1, 2, 3, 4, 5),
sys AS (SELECT mode, key, arm, {_MEANS} FROM grp GROUP BY 1, 2, 3),
w AS (SELECT mode, key, arm, rows, {", ".join(f"{m} * rows AS {m}" for m in SUMS)} FROM sys JOIN n USING (mode, key, arm)),
c AS (SELECT mode, key, arm, {COEFFICIENTS} FROM w),
e AS (SELECT mode, key, arm, count(*) AS held_rows, avg(abs({PREDICTION} - (observed - a))) AS mae FROM h JOIN c USING (mode, key) GROUP BY 1, 2, 3)
SELECT mode, key, arm, coalesce(rows, 0) AS rows, coalesce(regions, 0) AS regions, coalesce(dates, 0) AS dates,
  CASE WHEN coalesce(rows, 0) < 80 OR regions < 2 OR dates < 2 THEN 'insufficient_fitting_support' WHEN row_number() OVER (PARTITION BY rows, digest ORDER BY arm, mode, key) = 1 THEN 'fitted' ELSE 'reused_exact_recipe' END AS status,
  CASE WHEN rows >= 80 AND regions >= 2 AND dates >= 2 THEN round(c0, 5) END AS c0, CASE WHEN rows >= 80 AND regions >= 2 AND dates >= 2 THEN round(c1, 5) END AS c1, CASE WHEN rows >= 80 AND regions >= 2 AND dates >= 2 THEN round(c2, 5) END AS c2,
  CASE WHEN rows >= 80 AND regions >= 2 AND dates >= 2 THEN coalesce(held_rows, 0) ELSE 0 END AS held_rows, CASE WHEN rows >= 80 AND regions >= 2 AND dates >= 2 THEN round(mae, 5) END AS mae
FROM cat CROSS JOIN (SELECT unnest(['old_only', 'expanded']) AS arm) LEFT JOIN n USING (mode, key, arm) LEFT JOIN c USING (mode, key, arm) LEFT JOIN e USING (mode, key, arm)""")
def ml_11_split_trial(spark: SparkSession, d: str) -> DataFrame:
    """45 splits in two arms: one reading of the rows, one solution for each different recipe, errors on the held rows."""
    rows, cat = observed_rows(spark, d), catalogue(spark, d)
    excluded = trials.exclusions(rows, cat, "granule", "region_id", "m0", "m1")
    population = rows.filter(F.col("region_id") != REFERENCE)
    arms = {"old_only": F.col("utc_day") < F.to_date(F.lit("1998-01-01")), "expanded": F.lit(True)}
    target = F.col("observed") - F.col("a")
    fits = trials.trial(
        population, cat, excluded, arms, ident="sample_id", region="region_id", phase="phase", date="utc_day", acquisition="acquisition_id", granule="granule",
        area=F.col("area"), features=features(), target=target, alpha=1.0,
    )
    fits = trials.written(fits, "fits")
    errors = trials.scores(trials.held_rows(rows, cat, "region_id", "mid", [REFERENCE]), fits, features(), target)
    out = fits.join(errors, ["mode", "key", "arm"], "left")
    return out.select("mode", "key", "arm", "rows", "regions", "dates", "status", *(F.round(F.col("coefficients")[k], 5).alias(f"c{k}") for k in range(3)), F.coalesce("held_rows", F.lit(0)).cast("long").alias("held_rows"), F.round("mae", 5).alias("mae"))


@query(f"""WITH {SAMPLES_SQL}, r AS (SELECT DISTINCT acquisition_id FROM samples WHERE region_id = 'NATION_3'), a AS (SELECT arm, phase, region_id, count(*) AS n FROM samples, (SELECT unnest(['old_only', 'expanded']) AS arm) WHERE (arm = 'expanded' OR utc_day < DATE '1999-01-01') AND acquisition_id NOT IN (SELECT acquisition_id FROM r) GROUP BY 1, 2, 3)
SELECT phase, region_id, coalesce(max(n) FILTER (arm = 'old_only'), 0) AS old_only, coalesce(max(n) FILTER (arm = 'expanded'), 0) AS expanded FROM a GROUP BY 1, 2""")
def spl_06_arm_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both arms of the paired memberships from one count by granule, less the reserved granules: no row is copied for an arm."""
    s = samples(spark, d)
    by_granule = s.groupBy("phase", "region_id", "acquisition_id").agg(F.count_if(F.col("utc_day") < F.to_date(F.lit("1999-01-01"))).alias("old_only"), F.count(F.lit(1)).alias("expanded"))
    reserved = s.filter("region_id = 'NATION_3'").select("acquisition_id").distinct()
    return by_granule.join(reserved, "acquisition_id", "left_anti").groupBy("phase", "region_id").agg(F.sum("old_only").alias("old_only"), F.sum("expanded").alias("expanded"))
