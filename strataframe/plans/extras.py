"""Sources over raw text made from the tables, closed-form estimates, Spark ML and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimate, windows
from ..session import load
from ..sources import readers
from ..store import written
from ..streaming import streams
from .registry import query
from .views import PREDICTED_SQL, SAMPLES_SQL, predicted, samples

LEVELS = (["region_id", "phase"], ["utc_day"], ["acquisition_id"], ["surface"])
_FITTED = ("region_id", "phase", "utc_day", "acquisition_id", "surface", "a", "balance", "observed")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_07_json_field(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "struct<k: bigint>")["k"].alias("k"))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS hours, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def src_07_parallel_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Each type's hours as responses of parallel arrays, read back as one row a value."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(16))  # a response holds a part of an hour's values, so none grows with a type
    day = load(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("of_hour"), part.alias("part")).agg(F.collect_list(F.struct("event_id", "value")).alias("v"))
    raw = day.select("event_type", "day", F.to_json(F.struct(F.create_map(F.lit("value"), F.lit("u")).alias("hourly_units"), F.struct(F.transform("v", lambda x: x["value"]).alias("value"), F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.date_format(F.timestamp_seconds(i.cast("long") * 3600), "yyyy-MM-dd'T'HH:mm")).alias("time")).alias("hourly"))).alias("json"))
    rows = readers.hourly_response(raw, "json", ["value"], {"value": "u"})
    return rows.filter("problem IS NULL").groupBy("event_type", "day").agg(F.count("hour_utc").alias("hours"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_custkey, round(c_acctbal / 100, 1) + 0.0 AS value FROM customer WHERE c_custkey % 3 = 0 AND abs(round(c_acctbal / 100, 1)) < 999")
def src_05_packed_temperature(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").withColumn("v", F.round(F.col("c_acctbal") / 100, 1))
    packed = c.select("c_custkey", F.concat(F.when(F.col("v") < 0, "-").otherwise("+"), F.lpad(F.round(F.abs("v") * 10).cast("int").cast("string"), 4, "0"), F.lit(","), F.when(F.col("c_custkey") % 3 == 0, "1").otherwise("2")).alias("tmp"))
    return packed.select("c_custkey", readers.packed_temperature(F.col("tmp")).alias("value")).filter("value IS NOT NULL")


@query("SELECT l_orderkey AS station, variable, count(*) AS reports, round(sum(CASE WHEN variable = 'temperature' THEN l_quantity ELSE l_tax END), 4) AS total FROM lineitem, (SELECT unnest(['temperature', 'wind_speed']) AS variable) WHERE l_returnflag = 'A' OR l_linenumber = 1 GROUP BY 1, 2")
def src_03_station_archive(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows with codes to long form; usable are blank codes and code 1 of a harmonised source."""
    i = load(spark, d, "lineitem")
    code, source = F.when(F.col("l_returnflag") == "A", F.lit("")).when(F.col("l_linenumber") == 1, "1").otherwise("3"), F.lit("223")
    wide = i.select(F.col("l_orderkey").cast("string").alias("STATION"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("DATE"), F.col("l_quantity").cast("string").alias("temperature"), code.alias("temperature_Quality_Code"), source.alias("temperature_Source_Code"), F.col("l_tax").cast("string").alias("wind_speed"), code.alias("wind_speed_Quality_Code"), source.alias("wind_speed_Source_Code"))
    long = readers.station_long(wide, ["temperature", "wind_speed"])
    return long.filter("usable").groupBy(F.col("station").cast("long").alias("station"), "variable").agg(F.count(F.lit(1)).alias("reports"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS elevation FROM supplier")
def src_04_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("station_id"), F.lit("1").alias("lat"), F.lit("2").alias("lon"), F.when(F.col("s_suppkey") % 9 == 0, "-999.9").otherwise(F.col("s_acctbal").cast("string")).alias("elevation"))
    return readers.inventory(rows).select(F.col("station_id").cast("long").alias("s_suppkey"), "elevation")


@query("SELECT p_partkey, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM part, (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 2)) AS c)")
def src_12_grid_pixels(spark: SparkSession, d: str) -> DataFrame:
    grids = load(spark, d, "part").select("p_partkey", F.lit(3).alias("rows"), F.lit(2).alias("columns"))
    return readers.grid_pixels(grids, "rows", "columns", ["p_partkey"]).select("p_partkey", "row", F.col("column").alias("col"))


@query("SELECT CAST(o_orderkey % 100 AS BIGINT) AS physical_key, o_orderstatus AS phase, count(*) AS n FROM orders GROUP BY 1, 2")
def src_15_associations(spark: SparkSession, d: str) -> DataFrame:
    """Plans as nested JSON, read back as associations; revisions stay apart."""
    o = load(spark, d, "orders").select((F.col("o_orderkey") % 100).cast("string").alias("key"), F.struct(F.col("o_custkey").cast("string").alias("region"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("phase")).alias("g"), F.col("o_orderkey").cast("string").alias("revision"))
    source = F.struct("key", F.lit("2020-01-01 00:00:00").alias("start"), F.lit("2020-01-01 01:00:00").alias("end"), "revision", F.array("g").alias("groups"))
    raw = o.select(F.to_json(F.struct(F.array(source).alias("sources"))).alias("json"))
    return readers.associations(raw, "json").groupBy(F.col("physical_key").cast("long").alias("physical_key"), "phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PREDICTED_SQL}, m AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a) AS sa, sum(a * observed) AS ay, sum(observed) AS sy FROM predicted WHERE a IS NOT NULL), s AS (SELECT ((n + 1) * ay - sa * sy) / ((n + 1) * (aa + 1) - sa * sa) AS slope, ((aa + 1) * sy - sa * ay) / ((n + 1) * (aa + 1) - sa * sa) AS base FROM m) SELECT sample_id, round(base + slope * a, 5) AS fitted FROM predicted, s WHERE a IS NOT NULL")
def ml_04_ridge(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d).filter("a IS NOT NULL")
    features = [F.lit(1.0), F.col("a")]
    coefficients = estimate.ridge(rows, features, F.col("observed"), F.lit(1.0), 1.0)
    return rows.select("sample_id", F.round(estimate.linear(features, coefficients), 5).alias("fitted"))


@query()
def ml_02_linear_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Ridge baseline in Spark ML, and the frozen model's gate (ML-10)."""
    rows = written(predicted(spark, d).select("sample_id", "phase", "a", "balance", "observed", F.lit(1.0).alias("weight")), "predicted")
    model = estimate.offset_pipeline(["a", "balance"], "phase", "observed", "weight").fit(rows)
    return model.transform(rows).select("sample_id", F.round("prediction", 3).alias("prediction"))


@query()
def ml_01_boosted_offset(spark: SparkSession, d: str) -> DataFrame:
    known = written(predicted(spark, d).select(*_FITTED), "predicted")  # fits read their rows many times, weights twice
    rows = written(windows.balanced_weights(known, LEVELS).select("phase", "a", "balance", "observed", "weight"), "weighted")
    model = estimate.offset_pipeline(["a", "balance"], "phase", "observed", "weight", "trees", maxIter=8, maxDepth=3).fit(rows)
    return model.transform(rows).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col("observed"))).alias("mae"))


@query()
def ml_01_offset_from_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Trees learn the offset from the baseline, with balanced weights; the prediction is baseline plus offset."""
    known = written(predicted(spark, d).filter("a IS NOT NULL").select(*_FITTED).withColumn("offset", F.col("observed") - F.col("a")), "predicted")
    rows = written(windows.balanced_weights(known, LEVELS).select("phase", "a", "balance", "observed", "offset", "weight"), "weighted")
    model = estimate.offset_pipeline(["a", "balance"], "phase", "offset", "weight", "trees", maxIter=8, maxDepth=3).fit(rows)
    after = F.abs(F.col("a") + F.col("prediction") - F.col("observed"))
    return model.transform(rows).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("offset")).alias("baseline_mae"), F.avg(after).alias("mae"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    source = files.parquet(path) if _is_folder(spark, path) else files.option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return not (len(files) == 1 and files[0].rstrip("/").endswith(path.rsplit("/", 1)[-1]))


@query("SELECT user_id, count(*) AS kept FROM (SELECT DISTINCT user_id, ts FROM events WHERE value >= 1 AND event_type <> 'error') GROUP BY 1")
def str_01_screened_latest(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("value") >= 1, "too_small"), (F.col("event_type") != "error", "error_report")]
    out = streams.screened_latest(_stream(spark, d), rules, "user_id", "ts", "event_id", "value")
    return streams.drained(out, "screened-latest", ["user_id", "ts"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT e.event_id, h.n AS reports_that_hour FROM events e LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) h ON h.event_type = e.event_type AND h.hour = date_trunc('hour', e.ts)")
def str_02_enriched(spark: SparkSession, d: str) -> DataFrame:
    hourly = load(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("reports_that_hour"))
    return streams.drained(streams.enriched(_stream(spark, d).select("event_id", "event_type", "ts"), hourly, "event_type", "ts", ["reports_that_hour"]), "enriched").select("event_id", "reports_that_hour")


@query("WITH h AS (SELECT event_type, unnest(range(0, 6)) AS k, ts, value FROM events), w AS (SELECT event_type, date_trunc('hour', ts) + to_hours(CAST(k + 1 AS INT)) AS e, count(DISTINCT date_trunc('hour', ts)) AS n, sum(value) AS s FROM h GROUP BY 1, 2) SELECT event_type, strftime(e, '%Y-%m-%d %H') AS window_end, n AS valid_hours, round(CASE WHEN n = 6 THEN s END, 4) AS total FROM w")
def str_03_full_hours(spark: SparkSession, d: str) -> DataFrame:
    out = streams.full_hours(_stream(spark, d), "event_type", "ts", "value", 6)
    return streams.drained(out, "full-hours", ["event_type", "window_end"]).select("event_type", F.date_format("window_end", "yyyy-MM-dd HH").alias("window_end"), "valid_hours", F.round("total", 4).alias("total"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, round(0.5 * observed + 0.001 * balance, 6) AS prediction FROM samples")
def udf_01_table_model(spark: SparkSession, d: str) -> DataFrame:
    """Any predict(frame) over a wide table, batch by batch; refused as a whole if a feature isn't finite."""
    rows = samples(spark, d).select("sample_id", "observed", "balance")
    if bad := estimate.feature_gate(rows, ["observed", "balance"]):
        raise ValueError(f"{bad} rows with features that aren't finite")

    def predict(frames):
        for f in frames:
            yield f[["sample_id"]].assign(prediction=0.5 * f["observed"] + 0.001 * f["balance"])

    return rows.mapInPandas(predict, "sample_id long, prediction double").select("sample_id", F.round("prediction", 6).alias("prediction"))
