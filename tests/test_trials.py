"""Many fits in one pass against fits made one at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import trials

SCHEMA = "id long, region string, phase string, day string, acq long, granule long, mid string, m0 string, m1 string, area double, x double, y double, mode string, arm string"


def rows(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        acq = rng.randrange(60)
        month = f"2021-{rng.randint(1, 6):02d}"
        odd = rng.random()
        out.append((i, None if odd < 0.01 else f"r{acq % 7}", rng.choice(["day", "night"]), f"{month}-{rng.randint(1, 5)}", acq, None if 0.01 < odd < 0.02 else acq // 3, month, month, rng.choice([month, "2021-07"]), rng.uniform(1, 3), None if odd > 0.99 else rng.gauss(0, 1), float("nan") if 0.98 < odd < 0.99 else rng.gauss(2, 1), "clash", "clash"))
    return out


CATALOGUE = [("pilot", f"r{k}") for k in range(1, 6)] + [("reference", "r0"), ("pilot", "nowhere"), ("month", "2021-02"), ("month", "2021-07"), ("month", "1999-01"), ("full", "all")]


def members(data, mode, key, arm):
    use = [r for r in data if r[10] is not None and r[11] == r[11] and r[1] not in (None, "r0") and (arm == "expanded" or r[3] < "2021-04")]
    out = {r[5] for r in data if r[5] is not None and (mode in ("pilot", "reference") and r[1] == key or mode == "month" and key in (r[7], r[8]))}
    return [r for r in use if r[5] not in out]


def plain_fit(use, alpha):
    groups, weight = {}, []
    for r in use:
        groups.setdefault((r[1], r[2]), {}).setdefault(r[3], {}).setdefault(r[4], []).append(r[9])
    for r in use:
        days = groups[r[1], r[2]]
        weight.append(r[9] / sum(days[r[3]][r[4]]) / len(days[r[3]]) / len(days) / len(groups) * len(use))
    x, y, w = np.array([[1, r[10]] for r in use]), np.array([r[11] for r in use]), np.array(weight)
    return np.linalg.solve(x.T @ (x * w[:, None]) + alpha * np.eye(2), x.T @ (w * y))


def test_a_trial_equals_fits_one_at_a_time(spark):
    data = rows()
    df, cat = spark.createDataFrame(data, SCHEMA).drop("mode", "arm"), spark.createDataFrame(CATALOGUE, "mode string, key string")
    excluded = trials.exclusions(df, cat, "granule", "region", "m0", "m1")
    population = df.filter(~(F.col("region") == "r0") | F.col("region").isNull())
    features, target = [F.lit(1.0), F.col("x")], F.col("y")
    arms = {"old_only": F.col("day") < "2021-04", "expanded": F.lit(True)}
    fits = trials.trial(population, cat, excluded, arms, ident="id", region="region", phase="phase", date="day", acquisition="acq", granule="granule", area=F.col("area"), features=features, target=target, alpha=0.5, least=(80, 2, 2))
    fits = trials.written(fits, "fits")
    found = fits.collect()
    assert len(found) == 2 * len(CATALOGUE)
    recipes = {}
    for r in sorted(found, key=lambda r: (r.arm, r.mode, r.key)):
        use = members(data, r.mode, r.key, r.arm)
        assert (r.rows, r.regions, r.dates) == (len(use), len({u[1] for u in use} - {None}), len({u[3] for u in use})), r
        if len(use) < 80:
            assert r.status == "insufficient_fitting_support" and r.coefficients is None
            continue
        assert np.allclose(r.coefficients, plain_fit(use, 0.5), atol=1e-9)
        first = recipes.setdefault(tuple(sorted(u[0] for u in use)), f"{r.mode}/{r.key}/{r.arm}")
        assert r.origin == first and r.status == ("fitted" if first == f"{r.mode}/{r.key}/{r.arm}" else "reused_exact_recipe")
    assert {r.status for r in found} == {"fitted", "reused_exact_recipe", "insufficient_fitting_support"}

    counts = {(r.mode, r.key): r.n for r in trials.train_counts(population, cat, excluded, "granule").collect()}
    for mode, key in CATALOGUE:
        taken = trials.train_rows(population, excluded, mode, key, "granule").count()
        assert counts[mode, key] == taken
    held = trials.held_rows(df, cat, "region", "mid", ["r0"]).groupBy("mode", "key").count()
    assert {(r.mode, r.key): r["count"] for r in held.collect()} == {k: n for k in CATALOGUE if (n := sum(r[1] == k[1] if k[0] in ("pilot", "reference") else k[0] == "month" and r[6] == k[1] and r[1] is not None and r[1] != "r0" for r in data))}
    scored = {(r.mode, r.key, r.arm): (r.held_rows, r.mae) for r in trials.scores(trials.held_rows(df, cat, "region", "mid", ["r0"]), fits, features, target).collect()}
    fit = next(r for r in found if (r.key, r.arm) == ("r1", "expanded"))
    errors = [abs(fit.coefficients[0] + fit.coefficients[1] * r[10] - r[11]) for r in data if r[1] == "r1" and r[10] is not None and r[11] == r[11]]
    assert scored["pilot", "r1", "expanded"] == (len(errors), pytest.approx(np.mean(errors)))


def test_an_empty_table_has_no_fit(spark):
    df, cat = spark.createDataFrame([], SCHEMA).drop("mode", "arm"), spark.createDataFrame(CATALOGUE, "mode string, key string")
    excluded = trials.exclusions(df, cat, "granule", "region", "m0", "m1")
    found = trials.trial(df, cat, excluded, {"all": F.lit(True)}, ident="id", region="region", phase="phase", date="day", acquisition="acq", granule="granule", area=F.col("area"), features=[F.lit(1.0), F.col("x")], target=F.col("y"), alpha=0.5).collect()
    assert len(found) == len(CATALOGUE) and all(r.rows == 0 and r.status == "insufficient_fitting_support" for r in found)
    assert trials.out_of_fold(df.withColumn("fold", F.lit(1)), "fold", [F.col("x")], F.col("y"), F.lit(1.0), 1.0).count() == 0
    assert trials.experts(df, "region", F.col("n") > 1, [F.col("x")], F.col("y"), F.lit(1.0), 1.0).count() == 0


def test_folds_and_experts(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), int(i % 3) if i % 50 else None, f"g{i % 40}", float(a), float(2 * a + (i % 40) + e)) for i, (a, e) in enumerate(zip(rng.normal(size=800), rng.normal(size=800), strict=True))] + [(9000, 1, "g1", None, 3.0), (9001, 1, None, 1.0, 3.0)]
    df = spark.createDataFrame(data, "id long, fold int, g string, x double, y double")
    usable = [r for r in data if r[3] is not None]
    fit = lambda part: np.linalg.solve((m := np.array([[1, r[3]] for r in part])).T @ m + np.eye(2), m.T @ np.array([r[4] for r in part]))
    features = [F.lit(1.0), F.col("x")]
    oof = {r.id: r.oof_prediction for r in trials.out_of_fold(df, "fold", features, F.col("y"), F.lit(1.0), 1.0).collect()}
    for k in (0, 1, 2, None):
        c = fit([r for r in usable if r[1] != k])
        assert all(oof[r[0]] == pytest.approx(c[0] + c[1] * r[3]) for r in usable if r[1] == k)
    assert oof[9000] is None and len(oof) == len(data)
    routed = {r.id: (r.route, r.routed_prediction) for r in trials.experts(df, "g", (F.col("n") >= 20) & (F.col("g") != "g3"), features, F.col("y"), F.lit(1.0), 1.0).collect()}
    shared = fit(usable)
    for g in ("g1", "g3", None):
        own = [r for r in usable if r[2] == g]
        c = fit(own) if g == "g1" else shared
        assert all(routed[r[0]] == (g if g == "g1" else "shared", pytest.approx(c[0] + c[1] * r[3])) for r in own)


def shuffled_records(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_no_fit_copies_the_rows(spark):
    """Acquisitions over several granules, of which each of 60 fits leaves one out."""
    data = [(*r[:5], None if r[0] % 97 == 0 else r[0] % 60, *r[6:]) for r in rows(3000, 5)]
    df = spark.createDataFrame(data, SCHEMA).drop("mode", "arm")
    cat = spark.createDataFrame([("pilot", str(k)) for k in range(60)], "mode string, key string")
    excluded = spark.createDataFrame([("pilot", str(k), k) for k in range(60)], "mode string, key string, granule long")
    arms = {"odd": F.coalesce(F.col("granule") % 2 == 1, F.lit(False)), "all": F.lit(True)}
    before = set(shuffled_records(spark))
    found = trials.trial(df, cat, excluded, arms, ident="id", region="region", phase="phase", date="day", acquisition="acq", granule="granule", area=F.col("area"), features=[F.lit(1.0), F.col("x")], target=F.col("y"), alpha=0.5).collect()
    moved = sum(n for stage, n in shuffled_records(spark).items() if stage not in before)
    assert moved < 15 * len(data), moved  # 60 fits in two arms
    assert len(found) == 120
    for r in found:
        if r.key in ("0", "7", "59"):
            use = [u for u in members(data, "full", "all", "expanded") + [u for u in data if u[1] == "r0" and u[10] is not None and u[11] == u[11]] if u[5] != int(r.key) and (r.arm == "all" or u[5] is not None and u[5] % 2 == 1)]
            assert r.rows == len(use) and np.allclose(r.coefficients, plain_fit(use, 0.5), atol=1e-9)
