"""Estimators, frozen models, flux proxies and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import STEFAN_BOLTZMANN
from ..operators import apply, artefact, crosscheck, estimate, flux, robust, windows
from ..operators import trials as trial_operators
from ..session import load
from ..store import new_path, written
from .accuracy import LEVELS, _weights_sql
from .registry import query
from .trials import FEATURES, PREDICTION, features, solve_sql, sums_sql
from .views import HOURLY_SQL, PREDICTED_SQL, hourly_events, predicted

# robust estimators

#: Loss and scale of each variant, in thousands of the observed value.
VARIANTS = {"absolute": 5.0, "huber": 20.0}
_ROUNDS = 60


def _robust_sql() -> str:
    parts = [f"WITH {PREDICTED_SQL}, ok AS MATERIALIZED (SELECT sample_id, a, balance, observed - a AS y FROM predicted WHERE a IS NOT NULL)"]
    solved = ", ".join(f"{x} AS c{k}" for k, x in enumerate(solve_sql(0.001)))
    for name, scale in VARIANTS.items():
        parts.append(f"{name}0 AS (SELECT {solved} FROM (SELECT {sums_sql('y')} FROM ok))")
        for k in range(1, _ROUNDS + 1):
            w = f"({1.0 if name == 'absolute' else scale} / greatest(abs(y - ({PREDICTION})), {scale}))"
            parts.append(f"{name}{k} AS MATERIALIZED (SELECT {solved} FROM (SELECT {sums_sql('y', w)} FROM ok, {name}{k - 1}))")
    last = " UNION ALL ".join(f"SELECT '{name}' AS loss, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(avg(abs(y - ({PREDICTION}))), 5) AS mae FROM ok, {name}{_ROUNDS} GROUP BY ALL" for name in VARIANTS)
    return ",\n".join(parts) + " " + last


@query(_robust_sql())
def ml_09_robust(spark: SparkSession, d: str) -> DataFrame:
    """The offset from the baseline by two robust losses, each iterated until nothing moves."""
    rows = written(predicted(spark, d).filter("a IS NOT NULL").select("a", "balance", (F.col("observed") - F.col("a")).alias("y")), "robust-rows")
    out = None
    for name, scale in VARIANTS.items():
        fit = robust.robust(rows, features(), F.col("y"), F.lit(1.0), loss=name, scale=scale, alpha=0.001)
        if not fit.converged:
            raise RuntimeError(f"the {name} loss did not settle in {fit.rounds} rounds")
        one = rows.agg(F.round(F.avg(F.abs(F.col("y") - fit.predict(features()))), 5).alias("mae")).select(F.lit(name).alias("loss"), *(F.round(F.lit(c), 4).alias(f"c{k}") for k, c in enumerate(fit.coefficients)), "mae")
        out = one if out is None else out.union(one)
    return out


# a frozen model


@query(f"""WITH {PREDICTED_SQL}, ok AS (SELECT *, observed - a AS y FROM predicted WHERE a IS NOT NULL), s AS (SELECT {sums_sql("y")} FROM ok WHERE phase = 'F' AND product <> 'MACHINERY'), c AS (SELECT {", ".join(f"{x} AS c{k}" for k, x in enumerate(solve_sql(0.0)))} FROM s),
p AS (SELECT *, a IS NULL OR product = 'MACHINERY' AS bad FROM predicted), b AS (SELECT acquisition_id // 3 AS batch, min(CASE WHEN a IS NULL THEN 'invalid_x1' WHEN product = 'MACHINERY' THEN 'unknown_product' END) AS problem FROM p GROUP BY 1)
SELECT sample_id, CASE WHEN problem IS NULL THEN 'predicted' ELSE 'refused_batch' END AS status, problem, CASE WHEN problem IS NULL THEN round(a + {PREDICTION}, 5) END AS prediction FROM p JOIN b ON acquisition_id // 3 = batch, c""")
def ml_10_saved_model(spark: SparkSession, d: str) -> DataFrame:
    """A model that is fitted, written, loaded by its digest and applied; batches with an unknown product or no baseline are refused."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = predicted(spark, d).withColumns({"x1": F.col("a") / 100, "x2": F.col("balance") / 10000, "batch": F.expr("acquisition_id div 3")})
    fit = written(rows.filter("a IS NOT NULL AND phase = 'F' AND product <> 'MACHINERY'").withColumn("y", F.col("observed") - F.col("a")), "fit-rows")
    domain = [r.product for r in fit.select("product").distinct().collect()]  # a product segment each, five in all
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", solver="normal", regParam=0.0)])
    path = new_path(spark, "frozen-model")
    digest = artefact.save(pipeline.fit(fit), spark, path, features=["x1", "x2"], label="y", category="product", domain=domain)
    frozen = artefact.load(spark, path, digest)
    return artefact.score(frozen, rows, ["batch"], F.col("a")).select("sample_id", "status", "problem", F.round("prediction", 5).alias("prediction"))


# flux proxies

_FLUX = {
    "weather_ts": "CASE WHEN event_id % 5 = 0 THEN cutoff - INTERVAL 1 HOUR ELSE cutoff END",
    "radiation_ts": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE cutoff END",
    "optical_ts": "CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 10 MINUTE WHEN event_id % 13 <> 0 THEN ts - INTERVAL 40 MINUTE END",
    "older_optical_ts": "CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 3 HOUR END",
    "albedo": "event_id % 120 / 100.0",
    "shortwave": "CASE WHEN event_id % 2 = 0 THEN hour_value ELSE value - 5.0 END",
    "longwave": "CASE WHEN event_id % 17 <> 0 THEN value * 10.0 END",
    "air_c": "event_id % 60 - 20.0",
    "energy_6h_j_m2": "value * 21600.0",
    "history_end_ts": "CASE WHEN event_id % 4 = 0 THEN cutoff ELSE cutoff - INTERVAL 1 HOUR END",
    "history_status": "CASE WHEN event_id % 6 = 0 THEN 'missing_history' ELSE 'complete' END",
    "history_hours": "CASE WHEN event_id % 19 = 0 THEN 5 ELSE 6 END",
    "history_coverage": "1.0",
}
_OK = {
    "optical_causal": "coalesce(greatest(optical_ts, older_optical_ts) <= ts, false)",
    "albedo_valid": "albedo BETWEEN 0 AND 1",
    "shortwave_valid": "coalesce(shortwave >= 0, false)",
    "longwave_valid": "coalesce(longwave > 0, false)",
    "shortwave_time_valid": "weather_ts = cutoff",
    "longwave_time_valid": "coalesce(radiation_ts = cutoff, false)",
    "own": "energy_6h_j_m2 >= 0 AND history_end_ts = cutoff AND history_status = 'complete' AND history_hours = 6",
}


@query(f"""WITH {HOURLY_SQL}, six AS (SELECT key, hour, value, avg(value) OVER w AS mean6 FROM hourly WINDOW w AS (PARTITION BY key ORDER BY hour RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) QUALIFY count(*) FILTER (value >= 0) OVER w = 6),
e AS (SELECT event_id, event_type, events.ts, events.value, date_trunc('hour', events.ts) AS cutoff, hourly.value AS hour_value FROM events JOIN hourly ON hourly.key = event_type AND hourly.hour = date_trunc('hour', events.ts)),
i AS (SELECT event_id, event_type, ts, cutoff, {", ".join(f"{x} AS {k}" for k, x in _FLUX.items())} FROM e), f AS (SELECT *, {", ".join(f"{x} AS {k}" for k, x in _OK.items())} FROM i),
g AS (SELECT f.*, shortwave_time_valid AND coalesce(abs(shortwave - six.value) <= 1e-8, false) AS rebuilt, mean6 FROM f LEFT JOIN six ON six.key = event_type AND six.hour = cutoff),
h AS (SELECT *, CASE WHEN own THEN energy_6h_j_m2 / 21600 WHEN rebuilt THEN mean6 END AS mean, CASE WHEN own THEN 'existing_six_hour_energy' WHEN rebuilt AND mean6 IS NOT NULL THEN 'hourly_table' ELSE 'unavailable' END AS history_source FROM g),
p AS (SELECT *, CASE WHEN albedo_valid AND optical_causal AND shortwave_valid AND shortwave_time_valid THEN (1 - albedo) * shortwave END AS p1, CASE WHEN longwave_valid AND longwave_time_valid THEN longwave - {STEFAN_BOLTZMANN!r} * pow(air_c + 273.15, 4) END AS p2, CASE WHEN albedo_valid AND optical_causal AND mean IS NOT NULL THEN (1 - albedo) * mean END AS p3 FROM h)
SELECT event_id, round(p1, 6) AS absorbed_shortwave, round(p2, 6) AS net_longwave, round(p3, 6) AS recent_absorbed_shortwave, history_source, round(CASE WHEN mean IS NOT NULL THEN (epoch(ts) - epoch(cutoff)) / 60 END, 4) AS history_age_minutes, p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AS complete,
  concat_ws(';', CASE WHEN NOT optical_causal THEN 'missing_or_future_optical_source' END, CASE WHEN NOT albedo_valid THEN 'invalid_albedo' END, CASE WHEN NOT shortwave_valid THEN 'invalid_shortwave' END, CASE WHEN NOT longwave_valid THEN 'invalid_longwave' END,
    CASE WHEN NOT shortwave_time_valid THEN 'shortwave_hour_mismatch' END, CASE WHEN NOT longwave_time_valid THEN 'longwave_hour_mismatch' END, CASE WHEN mean IS NULL THEN 'incomplete_six_hour_history' END) AS unavailable_reason FROM p""")
def sc_07_three_proxies(spark: SparkSession, d: str) -> DataFrame:
    """Absorbed shortwave, net longwave and six-hour absorbed shortwave, with the checks against each."""
    hourly = written(hourly_events(spark, d).select("key", "hour", "value"), "hourly")
    events = load(spark, d, "events").withColumn("cutoff", F.date_trunc("hour", "ts"))
    joined = events.join(hourly.select(F.col("key").alias("event_type"), F.col("hour").alias("cutoff"), F.col("value").alias("hour_value")), ["event_type", "cutoff"])
    rows = joined.select("event_id", "event_type", "ts", "cutoff", *(F.expr(x).cast("double" if k in ("albedo", "shortwave", "longwave", "air_c", "energy_6h_j_m2", "history_coverage") else "int" if k == "history_hours" else "string" if k == "history_status" else "timestamp").alias(k) for k, x in _FLUX.items()))
    out = flux.flux_proxies(rows, hourly, "event_type")
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in flux.PROXIES), "history_source", F.round("history_age_minutes", 4).alias("history_age_minutes"), "complete", "unavailable_reason")


# a model that is told to all tasks


@query(f"""WITH {PREDICTED_SQL}, ok AS (SELECT *, observed - a AS y FROM predicted WHERE a IS NOT NULL), s AS (SELECT product, {sums_sql("y")} FROM ok GROUP BY 1), c AS (SELECT product, {", ".join(f"{x} AS c{k}" for k, x in enumerate(solve_sql(1.0)))} FROM s)
SELECT sample_id, round({PREDICTION}, 5) AS prediction FROM ok JOIN c USING (product)""")
def udf_01_broadcast_model(spark: SparkSession, d: str) -> DataFrame:
    """Any object with predict(frame), broadcast once and applied batch by batch: here a table of coefficients by product."""
    rows = predicted(spark, d).filter("a IS NOT NULL").withColumns({"x0": F.lit(1.0), "x1": F.col("a") / 100, "x2": F.col("balance") / 10000, "y": F.col("observed") - F.col("a")})
    rows = written(rows.select("sample_id", "product", "x0", "x1", "x2", "y"), "model-rows")
    systems = trial_operators.moments(rows, ["product"], [F.col(c) for c in ("x0", "x1", "x2")], F.col("y"), F.lit(1.0))
    fitted = trial_operators.solved(systems.drop("n"), 3, 1.0).collect()  # a row a product segment, five in all
    model = apply.ByGroup("product", ["x0", "x1", "x2"], {r["product"]: r.coefficients for r in fitted})
    return apply.predictions(rows, model, ["product", "x0", "x1", "x2"], ["sample_id"]).select("sample_id", F.round("prediction", 5).alias("prediction"))


# cross-checks


@query(f"WITH {PREDICTED_SQL}, ok AS (SELECT *, a - observed AS e FROM predicted WHERE a IS NOT NULL), {_weights_sql('ok', 'region_id, month')}, k AS (SELECT region_id, month, abs(e) AS r, sum(weight) OVER (PARTITION BY region_id, month ORDER BY abs(e) RANGE UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY region_id, month) AS total FROM w) SELECT region_id, month, round(coalesce(min(CASE WHEN run >= 0.75 * total - 1e-12 THEN r END), max(r)), 6) AS radius, true AS agree FROM k GROUP BY 1, 2")
def udf_03_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The distributed weighted quantile next to a grouped-aggregate function's, for groups of a region's month."""
    ok = predicted(spark, d).filter("a IS NOT NULL").withColumn("e", F.col("a") - F.col("observed"))
    weighted = written(windows.balanced_weights(ok, LEVELS, ["region_id", "month"]).select("region_id", "month", "e", "weight"), "weighted")
    both = crosscheck.both_radii(weighted, ["region_id", "month"], "e", "weight", 0.75)
    return both.select("region_id", "month", F.round("radius", 6).alias("radius"), "agree")


# a correction for one climate


def elimination_sql(p: int, alpha: float, source: str) -> str:
    """CTEs that solve the system of p features whose sums are m0, m1, ... in ``source``; the last, ``solved``, has c0, c1, ..."""
    at, k = {}, 0
    for i in range(p):
        for j in range(i, p):
            at[i, j] = at[j, i] = f"m{k}" + (f" + {alpha}" if i == j else "")
            k += 1
    at |= {(i, p): f"m{k + i}" for i in range(p)}
    parts = [f"e0 AS (SELECT {', '.join(f'{v} AS a{i}_{j}' for (i, j), v in at.items())} FROM {source})"]
    for s in range(p):
        cells = [f"a{i}_{j} / a{s}_{s} AS a{i}_{j}" if i == s else f"a{i}_{j} - a{i}_{s} * a{s}_{j} / a{s}_{s} AS a{i}_{j}" for i, j in at]
        parts.append(f"e{s + 1} AS (SELECT {', '.join(cells)} FROM e{s})")
    return ", ".join([*parts, f"solved AS (SELECT {', '.join(f'a{i}_{p} AS c{i}' for i in range(p))} FROM e{p})"])


def climate_terms(sun: Column, a: Column, b: Column, c: Column) -> list[Column]:
    return [a, b, c, sun, a * sun, b * sun, c * sun]


_TERMS = ["ndvi", "ndbi", "albedo", "sun", "ndvi * sun", "ndbi * sun", "albedo * sun"]
_INPUTS = {"ndvi": "(sample_id % 97) / 97.0", "ndbi": "(sample_id % 89) / 89.0 - 0.3", "albedo": "(sample_id % 83) / 166.0", "sun": "greatest(balance, 0.0) / 1000"}
_Z = [f"(({t}) - u{k}) / s{k}" for k, t in enumerate(_TERMS)]


@query(f"""WITH {PREDICTED_SQL}, i AS (SELECT *, {", ".join(f"{x} AS {k}" for k, x in _INPUTS.items())}, coalesce(product = 'BUILDING' AND balance > 0, false) AS active FROM predicted WHERE a IS NOT NULL), f AS (SELECT *, observed - a AS y FROM i WHERE active),
u AS (SELECT avg(y) AS base, {", ".join(f"avg({t}) AS u{k}, greatest(stddev_pop({t}), 1e-8) AS s{k}" for k, t in enumerate(_TERMS))} FROM f),
m AS (SELECT {", ".join([f"sum({_Z[i]} * {_Z[j]}) AS m{n}" for n, (i, j) in enumerate((i, j) for i in range(7) for j in range(i, 7))] + [f"sum({_Z[i]} * (y - base)) AS m{28 + i}" for i in range(7)])} FROM f, u), {elimination_sql(7, 10.0, "m")}
SELECT sample_id, round(CASE WHEN active THEN greatest(-2, least(2, base + {" + ".join(f"c{k} * {z}" for k, z in enumerate(_Z))})) ELSE 0 END, 5) AS correction FROM i, u, solved""")
def ml_07_climate_gate(spark: SparkSession, d: str) -> DataFrame:
    """Seven standardised terms of surface and sun, ridge on the residual of one climate's daytime rows, capped at 2; 0 elsewhere."""
    rows = predicted(spark, d).filter("a IS NOT NULL").withColumns({k: F.expr(x) for k, x in _INPUTS.items()})
    rows = rows.withColumn("active", F.coalesce((F.col("product") == "BUILDING") & (F.col("balance") > 0), F.lit(False)))
    correction = estimate.gated_correction(rows, F.col("active"), climate_terms(*(F.col(c) for c in ("sun", "ndvi", "ndbi", "albedo"))), F.col("observed") - F.col("a"), alpha=10.0, cap=2.0)
    return rows.select("sample_id", F.round(correction, 5).alias("correction"))
