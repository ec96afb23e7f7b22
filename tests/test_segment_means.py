"""Means of segments, nested by level, against plain means; rows travel once whatever the number of families and means."""

import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import metrics, windows
from strataframe.plans import accuracy

from .test_trials import shuffled_records

COLUMNS = ["region_id", "phase", "utc_day", "acquisition_id", "surface", "product", "x", "y"]


def rows(n, seed):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.3 else rng.gauss(0, 5)
    return [(rng.choice(["r1", "r2", "r3", None]), rng.choice("FO"), rng.randrange(4), rng.randrange(40), rng.choice("st"), rng.choice(["p", "q", None]), value(), value()) for _ in range(n)]


def nested(part, columns, k):
    if not columns:
        return sum(r[k] for r in part) / len(part)
    groups = {}
    for r in part:
        groups.setdefault(tuple(r[COLUMNS.index(c)] for c in columns[0]), []).append(r)
    return sum(nested(g, columns[1:], k) for g in groups.values()) / len(groups)


def moved(spark, df):
    before = set(shuffled_records(spark))
    found = df.collect()
    return found, sum(n for stage, n in shuffled_records(spark).items() if stage not in before)


def test_segments_share_their_groups_means(spark):
    data = rows(2000, 3)
    df = spark.createDataFrame(data, "region_id string, phase string, utc_day int, acquisition_id int, surface string, product string, x double, y double")
    families = accuracy.FAMILIES | {"by_surface_region": ["surface", "region_id"]}
    out = metrics.segment_means(df, families, accuracy.LEVELS, [], {"high": F.when(F.col("x") > 5, 1).otherwise(0)}, {"x": F.col("x"), "y": F.col("y")})
    found, records = moved(spark, out)
    assert records < 1.5 * len(data), records
    seen = set()
    for r in found:
        cols = [COLUMNS.index(c) for c in families[r.segment_type]]
        part = [u for u in data if "|".join(u[c] or "" for c in cols) == r.segment or not cols]
        seen.add((r.segment_type, r.segment))
        assert (r.n, r.high) == (len(part), sum(u[6] is not None and u[6] > 5 for u in part))
        for k, name in ((6, "x"), (7, "y")):
            assert r[name] == pytest.approx(nested([u for u in part if u[k] is not None], accuracy.LEVELS, k))
    assert len(seen) == len(found) == 1 + 4 + 2 + 3 + 8 + 8


@pytest.mark.parametrize("query", [accuracy.agg_04_model_segments, accuracy.agg_07_matched_and_own])
def test_no_model_view_or_family_copies_the_rows(spark, query, monkeypatch):
    data = spark.createDataFrame(rows(2000, 4), "region_id string, phase string, utc_day int, acquisition_id int, surface string, product string, a double, b double").withColumns({"sample_id": F.monotonically_increasing_id(), "c": F.col("a") + 1, "observed": F.lit(1.0)})
    monkeypatch.setattr(accuracy, "predicted", lambda *_: data)
    found, records = moved(spark, query(spark, "/root/testdata/sf0.001"))
    assert records < 2 * 2000, records
    local = data.collect()
    for r in found:
        if r.asDict().get("view") == "matched":
            assert r.n == sum(u.a is not None and u.b is not None and u.region_id == r.region_id for u in local)
        elif "view" in r or r.segment_type == "by_region":
            assert r.n == sum(u[r.model] is not None and (u.region_id or "") == (r.region_id if "view" in r else r.segment) for u in local)


def test_blocks_of_all_families_equal_those_of_copied_rows(spark):
    data = [(*(v or "none" if i in (0, 5) else v for i, v in enumerate(r[:6])), *r[6:]) for r in rows(2000, 6)]
    df = spark.createDataFrame(data, "region_id string, phase string, utc_day int, acquisition_id int, surface string, product string, e double, y double").drop("y").withColumn("b", F.lit(0.0))
    args = (["region_id", "acquisition_id"], ["region_id", "utc_day"], [1, 5])
    copied = windows.balanced_weights(metrics.explode_segments(df, accuracy.FAMILIES), accuracy.LEVELS, ["segment_type", "segment"])
    expected = {(r.segment_type, r.segment): r for r in metrics.weighted_metrics(copied, ["segment_type", "segment"], "e", "weight", *args).collect()}
    found = metrics.segment_blocks(df, accuracy.FAMILIES, accuracy.LEVELS, "e", *args).collect()
    assert len(found) == len(expected) == 1 + 4 + 2 + 3 + 8
    for r in found:
        want = expected[r.segment_type, r.segment].asDict()
        assert r.asDict() == {k: pytest.approx(v, abs=1e-12) if isinstance(v, float) else v for k, v in want.items()}


def test_segment_metrics_copy_no_row_for_a_family(spark, monkeypatch):
    """An acquisition in many families is known once for all of them: copies of rows would make 5 times as many records."""
    data = spark.createDataFrame(rows(2000, 7), "region_id string, phase string, utc_day int, acquisition_id int, surface string, product string, b double, y double").withColumn("observed", F.lit(1.0))
    monkeypatch.setattr(accuracy, "predicted", lambda *_: data)
    _, records = moved(spark, accuracy.agg_03_segment_metrics(spark, ""))
    assert records < 15 * 2000, records
