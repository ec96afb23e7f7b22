"""Projections there and back, distances over the poles, ranks under ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import grid
from strataframe.operators import joins, metrics


def arc_m(lat1, lon1, lat2, lon2):
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    return 2 * 6371e3 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_all_zones_and_caps_come_back_within_a_millimetre(spark):
    rng = random.Random(1)
    places = [(rng.uniform(lo, hi), -180 + 6 * z + rng.uniform(0, 5.999)) for z in range(60) for lo, hi in ((-80, 0), (0, 83.99), (84, 90), (-90, -80.01)) for _ in range(3)]
    places += [(90.0, 0.0), (-90.0, 10.0), (84.0, 0.0), (83.9999999, 0.0), (-80.0, 179.9), (-80.0000001, -180.0), (0.0, -180.0), (0.0, 180.0), (91.0, 0.0), (None, 0.0), (float("nan"), 0.0), (10.0, None)]
    df = spark.createDataFrame(places, "lat double, lon double")
    rows = grid.off_grid(grid.on_grid(df))
    seen = set()
    for r in rows.collect():
        if r.lat is None or r.lon is None or r.lat != r.lat or abs(r.lat) > 90:
            assert (r.zone, r.easting, r.lat_back) == (None, None, None)
            continue
        seen.add(r.zone)
        assert arc_m(r.lat, r.lon, r.lat_back, r.lon_back) < 1e-3, r
        assert -180 <= r.lon_back < 180.0000001 and r.zone == ("ups-n" if r.lat >= 84 else "ups-s" if r.lat < -80 else r.zone)
    assert len(seen) == 122
    # published: a place on the north cap, the pole itself, and one on a strip's central meridian at the equator
    known = {r.zone: (r.easting, r.northing) for r in grid.on_grid(spark.createDataFrame([(90.0, 0.0), (-90.0, 0.0), (0.0, 3.0)], "lat double, lon double")).collect()}
    assert known["ups-n"] == pytest.approx((2e6, 2e6)) and known["ups-s"] == pytest.approx((2e6, 2e6)) and known["utm-31n"] == pytest.approx((5e5, 0), abs=1e-6)
    scale = grid.ups(F.lit(90 - 1e-4), F.lit(90.0))[0] - 2e6
    assert spark.range(1).select(scale).first()[0] == pytest.approx(0.994 * math.radians(1e-4) * 6399593.626, rel=1e-6)
    unknown = spark.createDataFrame([("utm-61n", 5e5, 0.0), ("ups-x", 5e5, 0.0), (None, 5e5, 0.0), ("utm-31n", None, 0.0)], "zone string, easting double, northing double")
    assert [r.lat_back for r in grid.off_grid(unknown).collect()] == [None] * 4


def test_stations_within_a_distance_over_poles_and_antimeridian(spark):
    rng = random.Random(2)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)] + [(rng.choice([89.9, -89.95, 90, -90]), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.uniform(-1, 1), rng.choice([-179.99, 179.99, 180, -180])) for _ in range(60)]
    stations = [(i, float(a), float(b)) for i, (a, b) in enumerate(spots)] + [(9000, None, 1.0)]
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.sample(spots, 120))] + [(9001, 1.0, None)]
    for km in (30.0, 700.0, 5000.0, 21000.0):
        got = joins.within_distance(spark.createDataFrame(places, "place int, lat double, lon double"), spark.createDataFrame(stations, "station int, lat double, lon double"), "place", "station", km, 10**6)
        found = {(r.place, r.station) for r in got.collect()}
        want = {(p, s) for p, a, b in places if b is not None for s, c, d in stations if c is not None if arc_m(a, b, c, d) / 6371e3 * 6371.0088 <= km}
        assert found == want
    many = spark.range(20_000).select(F.col("id").alias("station"), (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    plan = joins.within_distance(spark.createDataFrame(places, "place int, lat double, lon double"), many, "place", "station", 50.0, 5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranks_where_a_third_of_all_rows_share_a_value(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 5, 2000).round(2), *[0.0] * 1500, *[1.25] * 1000]
    df = spark.createDataFrame([("k", float(v), float(w)) for v, w in zip(values, rng.uniform(0.5, 2, len(values)), strict=True)], "key string, v double, w double")
    ordered = sorted(abs(v) for v in values)
    for share in (0.05, 0.3, 0.33, 0.5, 0.7, 0.99):
        got = metrics.order_radius(df, ["key"], "v", share).first()
        assert got.radius == ordered[math.ceil((len(values) + 1) * share) - 1]
        rows = sorted(((abs(r.v), r.w) for r in df.collect()))
        goal, run = share * sum(w for _, w in rows) - 1e-12, 0.0
        for v, w in rows:
            run += w
            if run >= goal:
                break
        assert metrics.weighted_quantile_radius(df, ["key"], "v", "w", share).first().radius == v
    counted = metrics.order_statistics(df, ["key"], F.col("v"), {"a": lambda n: F.lit(1), "b": lambda n: n})
    assert (counted.first().a, counted.first().b) == (min(values), max(values))
