"""Models told to all tasks, digests of large groups, blocks of areas."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import apply, digests, joins, splits
from strataframe.operators.contracts import ContractError


def test_a_model_is_applied_batch_by_batch(spark):
    model = apply.ByGroup("g", ["x", "z"], {"a": [1.0, 2.0], "b": [0.5, 0.0]})
    df = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "b", 4.0, 9.0), (3, "c", 1.0, 1.0), (4, None, 1.0, 1.0), (5, "a", None, 1.0), (6, "a", 1e308, 1e308)], "id int, g string, x double, z double")
    got = {r.id: r.prediction for r in apply.predictions(df, model, ["g", "x", "z"], ["id"]).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None}
    assert apply.predictions(df.limit(0), model, ["g", "x", "z"], ["id"]).count() == 0
    for wrong in ({"inputs": ["g", "x", "q"]}, {"most_bytes": 10}):
        with pytest.raises(ContractError):
            apply.predictions(df, model, **({"inputs": ["g", "x", "z"], "keep": ["id"]} | wrong))


def test_digests_of_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [("hot", "x", f"v{rng.randrange(10**6)}") for _ in range(5000)] + [(f"g{i % 40}", None, f"{i}") for i in range(400)] + [(None, "x", "b"), (None, "x", "a"), (None, "x", None), ("empty", "y", None), ("same", "y", "s"), ("same", "y", "s"), ("blank", "y", "")]
    df = spark.createDataFrame(rows, "g string, h string, v string")
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).extend([v] if v is not None else [])
    for piece in (3, 4096):
        got = {(r.g, r.h): r.sha256 for r in digests.ordered_digest(df, ["g", "h"], "v", "\n", piece).collect()}
        assert got == {k: hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest() for k, v in want.items()}
    whole = digests.ordered_digest(spark.range(1000), [], "id", piece=7).first().sha256
    assert whole == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert digests.ordered_digest(df.limit(0), ["g"], "v").count() == 0


def test_blocks_of_an_area(spark):
    areas = spark.createDataFrame([("a", 0.0, 0.0, 25.0, 10.0), ("point", 1.0, 1.0, 1.0, 5.0), ("null", None, 0.0, 1.0, 1.0)], "area string, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, splits.area_blocks(areas, ["x0", "y0", "x1", "y1"], 10.0).select("area", "row", "col", "west", "south", "east", "north", "spatial_holdout").collect()))
    assert got == [("a", 0, 0, 0.0, 0.0, 10.0, 10.0, True), ("a", 0, 1, 10.0, 0.0, 20.0, 10.0, False), ("a", 0, 2, 20.0, 0.0, 25.0, 10.0, False)]


def test_a_schedule_of_any_length(spark):
    hours = spark.range(30_000).select(F.timestamp_seconds(F.col("id") * 3600 + 1_600_000_000 // 3600 * 3600).alias("hour"))
    tiles = spark.createDataFrame([("t",), ("u",)], "tile string")
    out = joins.schedule(tiles, hours.union(spark.createDataFrame([(None,)], "hour timestamp")))
    assert out.columns == ["tile", "hour"] and out.count() == 60_000 and out.distinct().count() == 60_000
    assert joins.schedule(tiles, hours.limit(0)).count() == 0
