"""Operators on small frames with values worked out by hand, and invariances."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from strataframe.functions import expr as E
from strataframe.operators import contracts, estimate, joins, metrics, splits, windows
from strataframe.sources import readers, sinks

T = lambda s: dt.datetime.fromisoformat(s)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_area_weights_of_a_worked_case(spark):
    df = spark.createDataFrame(
        [(1, "a", "day", "d1", "x", 1.0), (2, "a", "day", "d1", "x", 3.0), (3, "a", "day", "d1", "y", 2.0), (4, "a", "day", "d2", "z", 5.0), (5, "a", "night", "d1", "w", 7.0), (6, "b", "day", "d1", "v", 2.0)],
        "id int, region string, phase string, date string, acq string, area double",
    )
    got = dict(rows(windows.area_weights(df, ["region", "phase"], "date", "acq", "area"), "id", "weight"))
    want = {1: 1 / 48, 2: 1 / 16, 3: 1 / 12, 4: 1 / 6, 5: 1 / 3, 6: 1 / 3}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_balanced_weights_do_not_depend_on_pixel_counts(spark):
    base = [(i, "r" if i < 6 else "s", f"d{i % 3}", i % 2) for i in range(12)]
    df = spark.createDataFrame(base, "id int, region string, day string, acq int")
    more = spark.createDataFrame([x for x in base for _ in range(1 if x[2] == "d0" else 4)], df.schema)
    levels = (["region"], ["day"], ["acq"])
    mass = lambda f: {r[0]: r[1] for r in windows.balanced_weights(f, levels).groupBy("day").agg(F.sum("weight")).collect()}
    a, b = mass(df), mass(more)
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1)


def test_weights_are_taken_within_a_segment(spark):
    df = spark.createDataFrame([(1, "p", "r"), (2, "p", "s"), (3, "q", "r"), (4, None, "r")], "id int, seg string, region string")
    got = dict(rows(windows.balanced_weights(df, (["region"],), ["seg"]), "id", "weight"))
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0}


def test_constant_bias_has_no_contrast(spark):
    df = spark.createDataFrame([(i, f"d{i % 4}", i % 4, 2.5 * (i % 4), 1 / 16) for i in range(16)], "id int, day string, acq int, e double, w double").withColumn("seg", F.lit("x"))
    got = metrics.weighted_metrics(df, ["seg"], "e", "w", ["acq"], ["day"], [3]).first()
    assert got.contrast_mae == pytest.approx(0) and got.mae > 0 and got.date_count == 4


def hours(spark, values, start="2024-01-01T00:00:00"):
    return spark.createDataFrame([("k", T(start) + dt.timedelta(hours=i), v, 300.0, float(i)) for i, v in enumerate(values) if v != "gap"], "key string, hour timestamp, sw double, lw double, air double")


def test_thermal_memory_of_a_constant_day(spark):
    got = windows.thermal_memory(hours(spark, [100.0] * 24), ["key"], "hour", "sw", "lw", "air").orderBy(F.desc("hour")).first()
    assert (got.shortwave_energy_6h_j_m2, got.air_mean_6h_c, got.air_range_6h_c, got.air_mean_24h_c, got.air_change_3h_c) == (2_160_000.0, 20.5, 5.0, 11.5, 3.0)
    assert got.shortwave_6h_status == "complete"


def test_a_gap_or_an_invalid_value_breaks_a_window(spark):
    for bad in ("gap", -1.0, None):
        got = windows.thermal_memory(hours(spark, [100.0] * 20 + [bad] + [100.0] * 3), ["key"], "hour", "sw", "lw", "air").orderBy(F.desc("hour")).first()
        assert got.shortwave_energy_6h_j_m2 is None and got.shortwave_6h_valid_hours == 5 and got.shortwave_6h_status == "missing_history"


def test_containment_is_causal(spark):
    samples = spark.createDataFrame([(1, "r", 5.0, 5.0, T("2024-01-01T11:03:00")), (2, "r", 5.0, 5.0, T("2024-01-01T12:00:00")), (3, "r", 5.0, 5.0, T("2024-01-03T12:00:00")), (4, "r", 50.0, 5.0, T("2024-01-01T12:00:00"))], "id int, region string, x double, y double, ts timestamp")
    cells = spark.createDataFrame([("c", "r", 0.0, 0.0, 10.0, 10.0, T("2024-01-01T11:00:00"), T("2024-01-01T11:06:00"), 1.0)], "cell string, region string, x0 double, y0 double, x1 double, y1 double, start_ts timestamp, end_ts timestamp, view double")
    got = joins.contains_causal(samples, cells, ["region"], "id", 7.0, 86400, [F.desc("end_ts"), F.col("view"), F.col("cell")], ["cell"])
    assert rows(got.withColumn("cell", F.coalesce("cell", F.lit("-"))), "id", "cell") == [(1, "-"), (2, "c"), (3, "-"), (4, "-")]


@pytest.mark.parametrize("salt", [None, 5400.0, 90_000.0])
def test_asof_takes_the_last_report_within_tolerance(spark, salt):
    left = spark.createDataFrame([(1, "a", T("2024-01-01T10:00:00")), (2, "a", T("2024-01-01T12:00:00")), (3, "b", T("2024-01-01T10:00:00")), (4, "a", T("2024-01-01T08:00:00")), (5, None, T("2024-01-01T10:00:00")), (6, "a", None)], "id int, key string, ts timestamp")
    right = spark.createDataFrame([("a", T("2024-01-01T10:00:00"), 1.0, 1), ("a", T("2024-01-01T10:00:00"), 2.0, 2), ("a", T("2024-01-01T10:29:00"), 3.0, 3), ("b", T("2024-01-01T10:00:01"), 4.0, 4), ("a", None, 9.0, 5)], "key string, ts timestamp, v double, n int")
    got = {r.id: r.v for r in joins.asof_backward(left, right, ["key"], "ts", ["v"], 5400, "n", span_s=salt).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_cells_near_reserved_blocks(spark):
    """Ten-kilometre blocks of a 50 km area, one kilometre of buffer; a corner counts by its distance."""
    cells = [(n, (c + 0.5) * 100, 50_000 - (r + 0.5) * 100) for n, (c, r) in enumerate([(50, 450), (109, 450), (110, 450), (120, 450), (50, 350), (107, 392)])]
    df = spark.createDataFrame(cells, "id int, x double, y double").withColumn("area", F.lit(1))
    blocks = spark.createDataFrame([(r, c) for r in range(5) for c in range(5) if (r + 2 * c) % 5 == 0], "r int, c int").select((F.col("c") * 10000.0).alias("x0"), (F.col("c") * 10000.0 + 10000).alias("x1"), (F.col("r") * 10000.0).alias("y0"), (F.col("r") * 10000.0 + 10000).alias("y1"), F.lit(1).alias("area"))
    got = {r.id: (r.in_buffer, r.block_distance) for r in joins.min_block_distance(df, blocks, ["area"], "id", 50.0, 1000.0).collect()}
    inside = {n for n, (b, dist) in got.items() if dist == 0}
    assert inside == {0} and [got[n][0] for n in (1, 2, 3, 4, 5)] == [True, True, False, False, True]
    assert got[5][1] == pytest.approx(math.hypot(700, 700), abs=1)


def test_bracket_needs_both_ends_only_between_hours(spark):
    left = spark.createDataFrame([(1, "k", T("2024-01-01T01:00:00")), (2, "k", T("2024-01-01T00:15:00")), (3, "k", T("2024-01-01T01:30:00"))], "id int, key string, ts timestamp")
    got = {r.id: r.v for r in joins.bracket_interpolate(left, hours(spark, [10.0, 20.0]), ["key"], "ts", "hour", "sw", "v").collect()}
    assert got == {1: 20.0, 2: 12.5, 3: None}


def test_quality_codes(spark):
    cases = [("temperature", "1", "223", True), ("temperature", "0", "223", False), ("temperature", "0", "313", True), ("temperature", "s", "223", False), ("temperature", "n", "999", False), ("temperature", " ", "999", True), ("wind_speed", "0", "345", True), ("temperature", "0", "345", False)]
    df = spark.createDataFrame(cases, "v string, q string, s string, want boolean")
    assert df.filter(readers.quality_usable(F.col("v"), F.col("q"), F.col("s")) != F.col("want")).count() == 0


def test_packed_temperatures(spark):
    df = spark.createDataFrame([("+0260,1",), ("-0050,1",), ("+9999,1",), ("+0310,2",), ("+0275,0",), ("+0275,5",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.packed_temperature(F.col("t"))).collect()] == [26.0, -5.0, None, None, None, None, None, None]


def test_distance_across_the_antimeridian(spark):
    assert spark.range(1).select(E.haversine_km(0, 179.9, 0, -179.9)).first()[0] == pytest.approx(22.239016, abs=2e-3)


def test_projection_of_known_points(spark):
    """Published eastings and northings: the tower at 43.642567 N, 79.387139 W in zone 17."""
    x, y = E.utm(F.lit(43.642567), F.lit(-79.387139), F.lit(-81.0))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(630084, abs=2) and got[1] == pytest.approx(4833438, abs=2)
    x, y = E.utm(F.lit(0.0), F.lit(3.0), F.lit(3.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((500000, 0), abs=1e-6)


def test_hourly_responses(spark):
    good = '{"hourly_units": {"t": "C"}, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t": [1.5, null]}}'
    raw = spark.createDataFrame([(1, good), (2, good.replace('"C"', '"F"')), (3, good.replace(", null", "")), (4, good.replace("T01", "T02")), (5, "no json")], "id int, json string")
    got = readers.hourly_response(raw, "json", ["t"], {"t": "C"}).collect()
    assert [r.t for r in sorted((r for r in got if r.id == 1), key=lambda r: r.hour_utc)] == [1.5, None]
    assert {r.id: r.problem for r in got} == {1: None, 2: "unit of t", 3: "length of t", 4: "hours repeated, missing or out of order", 5: "unreadable"}


def test_report_verification(spark):
    raw = "METAR EGLL 011250Z 24010KT 9999 15/08 Q1012 RMK T01520080"
    cases = [(raw, "EGLL", "1250", 15.2, None), (raw, "EGKK", "1250", 15.2, "station_differs"), (raw, "EGLL", "1350", 15.2, "time_differs"), (raw, "EGLL", "1250", 15.0, "temperature_differs"), ("EGLL 011250Z M02/M05 Q1012", "EGLL", "1250", -2.4, None), ("EGLL 011250Z Q1012", "EGLL", "1250", 1.0, "no_temperature"), (None, "EGLL", "1250", 1.0, "no_raw_report")]
    df = spark.createDataFrame(cases, "raw string, station string, hhmm string, t double, want string")
    assert df.filter(~readers.verified_report(*map(F.col, ("raw", "station", "hhmm", "t"))).eqNullSafe(F.col("want"))).count() == 0


def test_granules_obstructions_and_index(spark):
    entry = '{"id": "g1", "title": "x", "time_start": "2024-01-01T00:00:00Z", "day_night_flag": "DAY", "polygons": [["0 0 0 2 2 2 0 0"]], "links": [{"rel": "http://x/data#", "href": "https://h/f"}]}'
    got = readers.granules(spark.createDataFrame([(entry,), (entry.replace("DAY", "?"),), ("{}",)], "j string"), "j").collect()
    assert [r.rejected_for for r in got] == [None, "no_phase_flag", "no_identity"]
    ring = spark.createDataFrame([(got[0].ring,)], "ring string").select(readers.ring_points(F.col("ring")).alias("p")).first().p
    assert [(p.x, p.y) for p in ring] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]
    lines = spark.createDataFrame([("12345 001 20240101T000000 yes",), ("12345 001 20240101T000000 yes",), ("broken",), ("",)], "value string")
    assert rows(readers.obstruction_list(lines), "parsed") == [(False,), (True,)]
    index = spark.createDataFrame([("1:0:d=2024010100:TMP:2 m above ground:anl:",), ("2:99:d=2024010100:DSWRF:surface:0-1 hour ave fcst:",)], "value string")
    assert rows(readers.forecast_index(index), "variable", "offset", "copies") == [("DSWRF", 99, 1), ("TMP", 0, 1)]


def test_minutes_with_codes(spark):
    text = "Station\n40 -88 230 m\n 2024 1 1 1 0 0 0.0 45.2 100.5 0 -9999.9 0\n 2024 1 1 1 0 1 0.0 45.2 7.0 1 3.0 0\n"
    got = readers.fixed_minutes(spark.createDataFrame([("s", text)], "station string, text string"), "text", ["zenith", "up", "down"])
    assert got.count() == 2 and got.columns == ["station", "minute_end_utc", "zenith", "up", "down"]


def test_names_and_cf_times(spark):
    df = spark.createDataFrame([("A_20240102T030405_x", 1.5, "hours since 2024-01-01 00:00:00"), ("P.2024032.0615.h5", 2.0, "days since 2024-01-01")], "n string, v double, u string")
    got = df.select(E.name_time(F.col("n")).alias("t"), E.cf_time(F.col("v"), F.col("u")).alias("c")).collect()
    assert [r.t for r in got] == [T("2024-01-02T03:04:05"), T("2024-02-01T06:15:00")]
    assert [r.c for r in got] == [T("2024-01-01T01:30:00"), T("2024-01-03T00:00:00")]


def test_identity_audit_and_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w")], "id int, v string")
    got = contracts.compare_identity(a, b, "id", ["v"]).first()
    assert (got.lost, got.added, got.changed) == (1, 1, 1)
    with pytest.raises(contracts.ContractError):
        contracts.join_validated(a, b.union(b), ["id"])
    assert rows(contracts.digest(a, ["id", "v"]), "hash_sum") == rows(contracts.digest(a.repartition(3), ["id", "v"]), "hash_sum")


def test_null_checks_reject(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, None)], "id int, land double")
    got = splits.admit(df, [(F.col("land") >= 0.8, "insufficient_land")])
    assert rows(got.withColumn("reason", F.coalesce("reason", F.lit(""))), "id", "reason", "kind") == [(1, "", "both"), (2, "insufficient_land", "excluded"), (3, "insufficient_land", "excluded")]


def test_acceptance_of_missing_groups(spark):
    schema = "region string, day string, q int, e double, leaked boolean"
    data = [("a", f"d{q}{i}", q, 1.0, False) for q in range(1, 5) for i in range(3)] + [("b", f"d{q}{i}", q, 9.0 if q == 2 else 1.0, q == 1) for q in range(1, 5) for i in range(3)]
    registry = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    got = {r.region: r for r in metrics.acceptance(spark.createDataFrame(data, schema), registry, ["region"], "day", "q", "e", "leaked", target=3, min_rows=12, min_dates=12, min_quarter_dates=3).collect()}
    assert got["a"].passed and got["a"].reasons == ""
    assert got["b"].reasons == "training_overlap;quarter_2_mae_target_failed"
    assert got["c"].reasons.startswith("missing_group;insufficient_reference_rows") and got["c"].date_mae is None and got["c"].reference_rows == 0


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    df = spark.createDataFrame([(f"d{i}", float(i % 5), 1.0) for i in range(60)], "day string, x double, n double")
    a = metrics.bootstrap(df, "day", ["x"], "n", 300, 1).first()
    assert a == metrics.bootstrap(df.repartition(5), "day", ["x"], "n", 300, 1).first()
    assert a.low < 2.0 < a.high and a["mean"] == pytest.approx(2, abs=0.1)


def test_ridge_is_exact(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - 3.0 * (i % 3)) for i in range(30)], "a double, b double, y double")
    assert list(estimate.ridge(df, [F.col("a"), F.col("b")], F.col("y"), F.lit(1.0), 0.0)) == pytest.approx([2, -3])


def test_spark_ml_ridge_and_fallback(spark):
    df = spark.createDataFrame([(float(i), "x" if i % 2 else "y", 2.0 * i, 1.0, i % 3) for i in range(40)], "a double, c string, y double, w double, fold int")
    pipeline = estimate.offset_pipeline(["a"], "c", "y", "w", regParam=0.0)
    oof = estimate.out_of_fold(df, "fold", 3, pipeline)
    assert oof.count() == 40 and oof.agg(F.max(F.abs(F.col("oof_prediction") - F.col("y")))).first()[0] < 1e-6
    assert estimate.feature_gate(df.withColumn("a", F.when(F.col("a") == 3, float("nan")).otherwise(F.col("a"))), ["a"]) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "fit"), (2, "evaluation"), (3, "fit")], "id int, kind string")
    assert sinks.fan_out(df, str(tmp_path / "k"), "kind", ["fit", "evaluation"]) == {"fit": 2, "evaluation": 1}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "k"))
    sinks.append_parts(df.filter("id = 1"), str(tmp_path / "p"), ["kind"], {"v": 1})
    done = sinks.read_parts(spark, str(tmp_path / "p"))
    assert rows(sinks.pending(df, done, ["id"], {"v": 1}), "id") == [(2,), (3,)]
    with pytest.raises(contracts.ContractError):
        sinks.pending(df, done, ["id"], {"v": 2})
    with pytest.raises(contracts.ContractError):
        readers.guarded_scan(spark, "/root/testdata/sf0.001/orders.parquet", "o_orderdate", "2000-01-01", "2001-01-01")


def test_entry_and_queries_on_the_smallest_tables(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("met", [1, 4, 256])
def test_containment_in_dense_cells_equals_all_pairs(spark, met):
    rng = random.Random(3)
    start = T("2024-01-01T00:00:00")
    at = lambda h: start + dt.timedelta(hours=h)
    samples = [(i, "r" if i % 3 else "s", rng.randrange(40) * 1.0, rng.randrange(40) * 1.0, at(rng.randrange(200)) if i else None) for i in range(120)]
    cells = [(i, rng.choice("rs"), x := rng.randrange(38) * 1.0, y := rng.randrange(30) * 1.0, x + rng.choice([0, 3, 9]), y + 6.0, at(h := rng.randrange(200)), at(h + rng.choice([1, 1, 30])), float(rng.randrange(3))) for i in range(1500)]
    want = {}
    for i, region, x, y, ts in samples:
        fits = [(-c[7].timestamp(), c[8], c[0]) for c in cells if ts and c[1] == region and c[2] <= x <= c[4] and c[3] <= y <= c[5] and c[7] <= ts and (ts - c[6]).total_seconds() <= 48 * 3600]
        want[i] = min(fits)[2] if fits else None
    left = spark.createDataFrame(samples, "id int, region string, x double, y double, ts timestamp")
    right = spark.createDataFrame(cells, "cell int, region string, x0 double, y0 double, x1 double, y1 double, start_ts timestamp, end_ts timestamp, view double")
    got = joins.contains_causal(left, right, ["region"], "id", 7.0, 48 * 3600, [F.desc("end_ts"), F.col("view"), F.col("cell")], ["cell"], met)
    assert {r.id: r.cell for r in got.collect()} == want and None in want.values()


def test_containment_does_not_meet_copies_of_a_cell(spark):
    """Work on copies: 400 points over 400 copies of a box are one point and one cell."""
    day = T("2024-01-01T00:00:00")
    left = spark.range(400).select(F.col("id"), F.lit("r").alias("region"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.lit(day + dt.timedelta(hours=5)).alias("ts"))
    right = spark.range(400).select(F.col("id").alias("cell"), F.lit("r").alias("region"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"), F.lit(day).alias("start_ts"), F.lit(day + dt.timedelta(hours=1)).alias("end_ts"))
    got = joins.contains_causal(left, right, ["region"], "id", 10.0, 86400, [F.desc("end_ts"), F.col("cell")], ["cell"])
    assert got.count() == 400 and {r.cell for r in got.collect()} == {0}
    assert most_rows(got) <= 800


def most_rows(df):
    """The most rows that a node of the last run of a plan put out."""
    df.collect()
    seen = []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            seen.append(metrics.get("numOutputRows").get().value())
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        else:
            for i in range(node.children().size()):
                walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(seen)
