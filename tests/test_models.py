"""Robust estimators, frozen models, flux proxies, gated corrections and cross-checks on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strataframe.operators import artefact, crosscheck, estimate, flux, robust
from strataframe.operators.contracts import ContractError
from strataframe.store import new_path


def test_robust_losses_are_minimised(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=400), rng.uniform(0.5, 2, 400)
    y = 1 + 2 * x + rng.normal(size=400) * 0.3
    y[::10] += 40  # outliers
    df = spark.createDataFrame([*zip(map(float, x), map(float, y), map(float, w), strict=True), (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, 0.0), (1.0, 1.0, None)], "x double, y double, w double")
    features = [F.lit(1.0), F.col("x")]
    for loss, scale in (("absolute", 1e-3), ("huber", 0.4)):
        fit = robust.robust(df, features, F.col("y"), F.col("w"), loss=loss, scale=scale, tolerance=1e-8)
        assert fit.converged and 1 < fit.rounds < 200 and fit.coefficients == pytest.approx([1, 2], abs=0.15)

        def total(c, loss=loss, scale=scale):
            r = np.abs(y - c[0] - c[1] * x)
            return float((w * (r if loss == "absolute" else np.where(r <= scale, r * r / 2, scale * (r - scale / 2)))).sum())

        best = total(fit.coefficients)
        assert all(total(np.add(fit.coefficients, step)) >= best - 1e-3 * (loss == "absolute") for step in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)))
    plain = estimate.ridge(df.dropna().filter("NOT isnan(y)"), features, F.col("y"), F.col("w"), 0.0)
    assert abs(plain[0] - 1) > 1
    # the weighted median, where there is an intercept alone
    median = robust.robust(df, [F.lit(1.0)], F.col("y"), F.col("w"), tolerance=1e-7)
    order = np.argsort(y)
    run = np.cumsum(w[order])
    assert median.coefficients[0] == pytest.approx(y[order][np.searchsorted(run, run[-1] / 2)], abs=0.02)
    assert robust.robust(df.limit(0), features, F.col("y"), F.col("w")) == (None, 0, False)
    assert robust.robust(df, [F.col("x"), F.col("x")], F.col("y"), F.col("w")).coefficients is None
    assert not robust.robust(df, features, F.col("y"), F.col("w"), rounds=1, tolerance=0.0).converged
    with pytest.raises(ValueError):
        robust.robust(df, features, F.col("y"), F.col("w"), loss="cubic")


def test_a_frozen_model_is_checked_before_use(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 1, "ab"[i % 2]) for i in range(40)], "x1 double, x2 double, y double, kind string")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", solver="normal")])
    path = new_path(spark, "model")
    digest = artefact.save(pipeline.fit(rows), spark, path, features=["x1", "x2"], label="y", category="kind", domain=["a", "b"])
    other = artefact.save(pipeline.fit(rows.withColumn("y", -F.col("y"))), spark, new_path(spark, "model"), features=["x1", "x2"], label="y")
    frozen = artefact.load(spark, path, digest)
    assert digest != other and frozen.features == ["x1", "x2"] and frozen.domain == ["a", "b"]
    with pytest.raises(ContractError):
        artefact.load(spark, path, other)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        artefact.save(frozen.model, spark, path, features=["x1", "x2"], label="y")
    nan = float("nan")
    cases = [
        (1, "good", 1.0, 1.0, 5.0, "a"), (2, "good", 2.0, 0.0, 5.0, "b"), (3, "nan", 1.0, nan, 5.0, "a"), (4, "nan", 1.0, 1.0, 5.0, "a"), (5, "null", None, 1.0, 5.0, "a"),
        (6, "kind", 1.0, 1.0, 5.0, "c"), (7, "kind", 1.0, 1.0, 5.0, "a"), (8, "no kind", 1.0, 1.0, 5.0, None), (9, None, 1.0, 1.0, 5.0, "a"), (10, "base", 1.0, 1.0, nan, "a"), (11, "huge", 1e308, 1.0, 1e308, "a"), (12, "huge", 1.0, 1.0, 1.0, "a"),
    ]
    df = spark.createDataFrame(cases, "id int, batch string, x1 double, x2 double, base double, kind string")
    got = {r.id: r for r in artefact.score(frozen, df, ["batch"], F.col("base")).collect()}
    assert len(got) == len(cases) and {i for i, r in got.items() if r.status == "predicted"} == {1, 2, 9}
    assert got[1].offset == pytest.approx(3) and got[1].prediction == pytest.approx(8) and all(r.prediction is None and r.offset is None for r in got.values() if r.status != "predicted")
    assert {i: r.problem for i, r in got.items() if r.problem} == {3: "invalid_x2", 4: "invalid_x2", 5: "invalid_x1", 6: "unknown_kind", 7: "unknown_kind", 8: "unknown_kind", 10: "invalid_baseline", 11: "invalid_result", 12: "invalid_result"}
    assert artefact.score(frozen, df.limit(0), ["batch"], F.col("base")).count() == 0
    with pytest.raises(ContractError):
        artefact.score(frozen, df.drop("x2"), ["batch"], F.col("base"))


SIX = dt.datetime(2021, 6, 1, 12)
FLUX = "id int, key string, ts timestamp, weather_ts timestamp, radiation_ts timestamp, optical_ts timestamp, older_optical_ts timestamp, albedo double, shortwave double, longwave double, air_c double, energy_6h_j_m2 double, history_end_ts timestamp, history_status string, history_hours int, history_coverage double"


def flux_row(i, **changes):
    row = {"id": i, "key": "k", "ts": SIX + dt.timedelta(minutes=25), "weather_ts": SIX, "radiation_ts": SIX, "optical_ts": SIX, "older_optical_ts": None, "albedo": 0.25, "shortwave": 400.0, "longwave": 300.0, "air_c": 20.0, "energy_6h_j_m2": 6 * 3600 * 200.0, "history_end_ts": SIX, "history_status": "complete", "history_hours": 6, "history_coverage": 1.0}
    return tuple((row | changes).values())


def test_flux_proxies_need_valid_causal_inputs_of_the_hour(spark):
    later, hour = SIX + dt.timedelta(minutes=26), dt.timedelta(hours=1)
    gone = {"history_status": "missing_history"}
    rows = [
        flux_row(1), flux_row(2, optical_ts=later), flux_row(3, optical_ts=None), flux_row(4, older_optical_ts=later), flux_row(5, albedo=1.01), flux_row(6, albedo=None), flux_row(7, shortwave=-1.0), flux_row(8, weather_ts=SIX - hour),
        flux_row(9, longwave=0.0), flux_row(10, air_c=-273.15), flux_row(11, radiation_ts=None), flux_row(12, ts=None), flux_row(13, **gone), flux_row(14, history_end_ts=SIX - hour), flux_row(15, history_hours=5), flux_row(16, history_coverage=0.9), flux_row(17, key="gap", **gone),
        flux_row(18, shortwave=401.0, **gone), flux_row(19, energy_6h_j_m2=float("nan")), flux_row(20, key=None, **gone), flux_row(21, albedo=float("nan")),
    ]
    hourly = [("k", SIX - k * hour, 400.0 - 10 * k) for k in range(8)] + [("gap", SIX - k * hour, 400.0) for k in range(8) if k != 3] + [("gap", SIX - 3 * hour, -1.0)]
    out = flux.flux_proxies(spark.createDataFrame(rows, FLUX), spark.createDataFrame(hourly, "key string, hour timestamp, value double"), "key")
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    one = got[1]
    assert (one.absorbed_shortwave, one.recent_absorbed_shortwave, one.history_source, one.history_age_minutes, one.complete, one.unavailable_reason) == (300.0, 150.0, "existing_six_hour_energy", 25.0, True, "")
    assert one.net_longwave == pytest.approx(300 - 5.670374419e-8 * 293.15**4)
    reasons = {2: "missing_or_future_optical_source", 3: "missing_or_future_optical_source", 4: "missing_or_future_optical_source", 5: "invalid_albedo", 6: "invalid_albedo", 7: "invalid_shortwave", 8: "shortwave_hour_mismatch", 9: "invalid_longwave", 10: "invalid_air_temperature", 11: "longwave_hour_mismatch", 17: "incomplete_six_hour_history", 18: "incomplete_six_hour_history", 20: "incomplete_six_hour_history", 21: "invalid_albedo"}
    assert {i: got[i].unavailable_reason for i in reasons} == reasons and not any(got[i].complete for i in reasons)
    assert got[12].unavailable_reason == "missing_target_time;missing_or_future_optical_source;shortwave_hour_mismatch;longwave_hour_mismatch;incomplete_six_hour_history"
    assert all(got[i].net_longwave is not None for i in (2, 5, 7, 8, 17)) and got[9].absorbed_shortwave == 300 and got[8].recent_absorbed_shortwave == 150
    for i in (13, 14, 15, 16, 19):  # had from the hourly table
        assert got[i].history_source == "hourly_table" and got[i].recent_absorbed_shortwave == pytest.approx(0.75 * 375) and got[i].complete


def test_a_correction_acts_on_its_climate_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), bool(a), float(x), float(z), float(3 * x + 0.5 * z)) for i, (a, x, z) in enumerate(zip(rng.random(300) < 0.4, rng.normal(size=300), rng.normal(size=300), strict=True))] + [(900, None, 1.0, 1.0, 1.0), (901, True, None, 1.0, 1.0), (902, True, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, active boolean, x double, z double, r double")
    column = estimate.gated_correction(df, F.col("active"), [F.col("x"), F.col("z")], F.col("r"), alpha=4.0, cap=2.0)
    got = {r.id: r.c for r in df.select("id", column.alias("c")).collect()}
    fit = np.array([r[2:] for r in rows[:300] if r[1]])
    z = (fit[:, :2] - fit[:, :2].mean(0)) / fit[:, :2].std(0)
    c = np.linalg.solve(z.T @ z + 4 * np.eye(2), z.T @ (fit[:, 2] - fit[:, 2].mean()))
    for r in rows[:300]:
        want = np.clip(fit[:, 2].mean() + ((np.array(r[2:4]) - fit[:, :2].mean(0)) / fit[:, :2].std(0)) @ c, -2, 2) if r[1] else 0.0
        assert got[r[0]] == pytest.approx(want, abs=1e-9)
    assert got[900] == 0 and got[901] == 0 and got[902] != 0 and max(got.values()) == 2
    none = estimate.gated_correction(df.limit(0), F.col("active"), [F.col("x")], F.col("r"), alpha=1.0, cap=1.0)
    assert {r[0] for r in df.select(none).collect()} == {0.0}


def test_grouped_and_distributed_quantiles_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 5}", float(e), float(w)) for i, (e, w) in enumerate(zip(rng.normal(size=500).round(1), rng.integers(1, 5, 500), strict=True))] + [("g0", None, 1.0), ("one", -3.0, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, e double, w double")
    for level in (0.1, 0.5, 0.9, 1.0):
        both = crosscheck.both_radii(df.filter("k IS NOT NULL"), ["k"], "e", "w", level).collect()
        assert len(both) == 6 and all(r.agree for r in both) and {r.radius for r in both if r.k == "one"} == {3.0}
    with pytest.raises(ContractError, match="more than 50 rows"):
        crosscheck.grouped_radius(df, ["k"], "e", "w", 0.5, most_rows=50)
