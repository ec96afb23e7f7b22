"""A response of many hours costs time by its length, not its square."""

import json
import time

from strataframe.sources import readers


def test_a_long_response_is_read_in_linear_time(spark):
    n = 6_000
    times = [f"20{20 + k // 8640:02d}-{k // 720 % 12 + 1:02d}-{k // 24 % 30 + 1:02d}T{k % 24:02d}:00" for k in range(600)]
    good = {"hourly_units": {"t": "C"}, "hourly": {"time": times * (n // 600), "t": [1.0] * n}}
    raw = spark.createDataFrame([(1, json.dumps(good))], "id int, json string")
    readers.hourly_response(raw.limit(0), "json", ["t"], {"t": "C"}).count()
    began = time.time()
    found = readers.hourly_response(raw, "json", ["t"], {"t": "C"}).collect()
    assert [r.problem for r in found] == ["hours repeated, missing or out of order"] and time.time() - began < 20
    fine = {"hourly_units": {"t": "C"}, "hourly": {"time": [f"2024-01-{d:02d}T{h:02d}:00" for d in range(1, 31) for h in range(24)], "t": [2.0] * 720}}
    assert readers.hourly_response(spark.createDataFrame([(1, json.dumps(fine))], "id int, json string"), "json", ["t"], {"t": "C"}).filter("problem IS NULL AND t = 2").count() == 720
