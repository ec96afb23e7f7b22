"""Release operators on small cases that the queries over the tables do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import metrics, release
from strataframe.operators.contracts import ContractError
from strataframe.store import new_path


def inside_share(px, py, x, y, half, n=400):
    """Share of a fine raster of points in the square that the polygon holds."""
    at = (np.arange(n) + 0.5) / n * 2 * half - half
    gx, gy = np.meshgrid(x + at, y + at)
    ok = np.ones_like(gx, bool)
    for i in range(len(px)):
        j = (i + 1) % len(px)
        ok &= (px[j] - px[i]) * (gy - py[i]) - (py[j] - py[i]) * (gx - px[i]) >= 0
    return ok.mean()


def test_areas_in_common_with_convex_polygons():
    rng = np.random.default_rng(5)
    px, py, x, y = [], [], [], []
    for _ in range(60):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 4))
        px.append(3 * np.cos(turn)), py.append(3 * np.sin(turn))
        x.append(rng.uniform(-3, 3)), y.append(rng.uniform(-3, 3))
    px, py, x, y = map(np.array, (px, py, x, y))
    got = release.clipped_areas(x, y, 1.0, px, py)
    want = [4 * inside_share(px[i], py[i], x[i], y[i], 1.0) for i in range(60)]
    assert np.abs(got - want).max() < 0.02 and (got == 0).any() and (got > 1).any()
    whole = release.clipped_areas(np.zeros(1), np.zeros(1), 1.0, np.array([[-5.0, 5, 5, -5]]), np.array([[-5.0, -5, 5, 5]]))
    assert whole[0] == 4


def test_overlay_on_a_polygon(spark):
    """A triangle-like quadrilateral over four cells: means by the exact areas in common."""
    fine = spark.createDataFrame([(50.0, 50.0, 1.0, True), (150.0, 50.0, 2.0, True), (50.0, 150.0, 4.0, False), (150.0, 150.0, 8.0, None)], "x double, y double, v double, ok boolean")
    poly = spark.createDataFrame([(1, [0.0, 200.0, 100.0, 0.0], [0.0, 0.0, 100.0, 200.0])], "id int, xs array<double>, ys array<double>")
    r = release.polygon_overlay(fine, poly, 100.0, "id", "v", F.col("ok")).first()
    assert r.valid_fraction == pytest.approx((10_000 + 5_000) / 20_000) and r["mean"] == pytest.approx((10_000 * 1 + 5_000 * 2) / 15_000) and r.cells == 2
    moved = {(r.dx, r.dy): r for r in release.polygon_overlay(fine, poly, 100.0, "id", "v", F.col("ok"), [(-300, 0), (50, 0)]).collect()}
    assert set(moved) == {(50.0, 0.0)}


def geodesic_km(lat1, lon1, lat2, lon2):
    """Vincenty's iteration."""
    a, f = 6378.137, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat1, lat2))
    apart = lon = np.radians(lon2 - lon1)
    for _ in range(200):
        ss = np.hypot(np.cos(u2) * np.sin(lon), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lon))
        cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lon)
        sa = np.cos(u1) * np.cos(u2) * np.sin(lon) / ss if ss else 0.0
        c2 = 1 - sa**2
        cm = cs - 2 * np.sin(u1) * np.sin(u2) / c2 if c2 else 0.0
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        lon = apart + (1 - c) * f * sa * (np.arctan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
    k = c2 * (a**2 - b**2) / b**2
    A, B = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))), k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    return b * A * (np.arctan2(ss, cs) - B * ss * (cm + B / 4 * (cs * (2 * cm**2 - 1) - B / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3))))


def test_distance_on_the_ellipsoid(spark):
    rng = np.random.default_rng(1)
    points = [(float(a), float(b), float(c), float(b + e)) for a, b, c, e in zip(rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60), rng.uniform(-80, 80, 60), rng.uniform(-90, 90, 60))]
    near = [(a, b, a + d / 100, b + e / 100) for (a, b, _, _), d, e in zip(points, rng.uniform(-50, 50, 60), rng.uniform(-50, 50, 60))]
    df = spark.createDataFrame([*points, *((float(a), float(b), float(c), float(d)) for a, b, c, d in near), (0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    for r in df.withColumn("km", release.ellipsoid_km(*(F.col(c) for c in "abcd"))).collect():
        assert r.km == pytest.approx(geodesic_km(*r[:4]) if r[:4] != (10.0, 20.0, 10.0, 20.0) else 0.0, rel=1e-5, abs=1e-4)


def test_contracts_of_registries_and_native_tables(spark):
    old = spark.createDataFrame([("a", "d1")], "region string, date string")
    new = spark.createDataFrame([("b", "d1", "dev")], "region string, date string, role string")
    got = release.combine_registries(old, new, "region", ["region", "date"], "role", {"dev": "new_development"}, ["a"]).collect()
    assert {(r.region, r.geography_role, r.group_id) for r in got} == {("a", "original_reference", "a|d1"), ("b", "new_development", "b|d1")}
    for bad in (new.withColumn("role", F.lit("other")), new.withColumn("region", F.lit("a")), new.union(new)):
        with pytest.raises(ContractError):
            release.combine_registries(old, bad, "region", ["region", "date"], "role", {"dev": "new_development"}, []).count()
    path = new_path(spark, "native-test")
    spark.createDataFrame([(2021, 1.0), (2023, 2.0)], "year int, v double").write.partitionBy("year").parquet(path)
    with pytest.raises(ContractError):
        release.native_tables(spark, path, "year", [2021, 2022], F.lit(True), ["v"])
    assert release.native_tables(spark, path, "year", [2021, 2022, 2023], F.col("v") > 1, ["year", "v"]).collect() == [(2023, 2.0)]


def test_a_batch_is_refused_as_a_whole(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0), ("y", float("nan")), ("z", None)], "batch string, a double")
    got = release.frozen_apply(df, "batch", ["a"], F.col("a") * 2).collect()
    assert sorted((r.batch, r.prediction, r.status) for r in got if r.batch == "x") == [("x", 2.0, "predicted"), ("x", 4.0, "predicted")]
    assert all(r.prediction is None and r.status == "refused_batch" for r in got if r.batch != "x")


def test_columns_are_replaced_in_order_or_not_at_all(spark):
    df = spark.createDataFrame([(1, 5, 0, 0), (2, 6, 0, 0)], "id int, keep int, m int, n int")
    values = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.25, 2.0)], "id int, p double, q double")
    assert sorted(map(tuple, release.replace_columns(df, ["m", "n"], values, "id", ["p", "q"]).collect())) == [(1, 5, 0.5, 1.0), (2, 6, 0.25, 2.0)]
    for wrong in (values.filter("id = 1"), values.union(values), values.withColumn("q", F.lit(None).cast("double"))):
        with pytest.raises(ContractError):
            release.replace_columns(df, ["m", "n"], wrong, "id", ["p", "q"])


def test_order_statistics_without_sorting_a_key(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(0, 50, 700), *[0.0] * 30, *[3.5] * 200, -1e-300, 1e300]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 2.0), ("none", None)], "key string, v double")
    ordered = sorted(values)
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in (1, 2, 250, 480, 500, len(values), len(values) + 1)}
    got = {r.key: r for r in metrics.order_statistics(df, ["key"], F.col("v"), ranks).collect()}
    assert got["k"].n == len(values) and got["one"].n == 1 and got["none"].n == 0 and got["none"].r1 is None
    for i in (1, 2, 250, 480, 500, len(values)):
        assert got["k"][f"r{i}"] == ordered[i - 1]
    assert got["k"][f"r{len(values) + 1}"] is None and got["one"].r1 == 2.0 and got["one"].r2 is None
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        q = {r.key: r.q for r in metrics.quantile(df, ["key"], F.col("v"), share, "q").collect()}
        assert q["k"] == pytest.approx(np.quantile(values, share)) and q["one"] == 2.0 and q["none"] is None


def test_full_windows_need_different_hours(spark):
    from strataframe.streaming import streams

    rows = [("a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in range(6)] + [("b", f"2024-01-01 {h:02d}:30:00", 2.0) for h in range(6)] + [("b", "2024-01-01 02:45:00", 3.0), ("c", "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "key string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.key, r.window_end.hour): (r.valid_hours, r.total) for r in streams.full_hours(df, "key", "ts", "v", 6).collect()}
    assert got["a", 6] == (1, None) and got["b", 6] == (6, 15.0) and got["b", 5] == (5, None) and got["c", 6] == (0, None)


def test_places_in_a_queue_by_spans(spark):
    from strataframe.operators import windows

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(str(q), int(t), i) for i, (q, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 40, 200)))] + [(None, 1, 999)], "q string, t int, id int")
    whole, cut = (sorted(map(tuple, windows.turns(df, ["q"], [F.col("t"), F.col("id")], span=s).select("id", "turn").collect())) for s in (None, F.floor(F.col("t") / 7)))
    assert whole == cut
