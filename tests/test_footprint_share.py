"""Shares of an extent inside convex rings, a row a scene."""

import pytest
from pyspark.sql import functions as F

from strataframe.operators import release


def test_shares_of_rings_of_several_sizes_and_turns(spark):
    square, triangle = ([0.0, 5.0, 5.0, 0.0], [0.0, 0.0, 10.0, 10.0]), ([0.0, 10.0, 0.0], [0.0, 0.0, 10.0])
    data = [(1, *square), (2, *(v[::-1] for v in square)), (3, *triangle), (4, None, None), (5, [0.0, None, 5.0], [0.0, 1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, xs array<double>, ys array<double>")
    found = release.footprint_share(df, "id", "xs", "ys", [F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)], 10)
    assert {r.id: r.share for r in found.collect()} == {1: 0.5, 2: 0.5, 3: pytest.approx(0.55), 4: 0.0, 5: 0.0}


def test_a_small_table_is_dealt_out_and_points_are_no_rows(spark):
    df = spark.range(50).coalesce(1).select("id", F.array(F.lit(0.0), F.lit(5.0), F.lit(0.0)).alias("xs"), F.array(F.lit(0.0), F.lit(0.0), F.lit(5.0)).alias("ys"))
    found = release.footprint_share(df, "id", "xs", "ys", [F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "REPARTITION_BY_NUM" in plan
