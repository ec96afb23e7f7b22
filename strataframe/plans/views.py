"""Observation tables made from the given ones: the same rows in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Three predictions of each order's price, in thousands; orders without items have none."""
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg((F.sum(price) / 1000).alias("a"), (F.sum(price * (1 - off)) / 1000).alias("b"), (F.sum(price * (1 - off) * (1 + tax)) / 1000).alias("c"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Orders as labelled samples: region, phase, time, acquisition, surface and an observed value in thousands."""
    customers = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nations = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    orders = load(spark, d, "orders")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # the fixed 25 nations
        .select(
            F.col("o_orderkey").alias("sample_id"), F.col("n_name").alias("region_id"), F.col("o_orderstatus").alias("phase"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("utc_day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
            F.quarter("o_orderdate").alias("quarter"), F.col("o_custkey").alias("acquisition_id"), F.col("o_orderpriority").alias("surface"), F.col("c_mktsegment").alias("product"), F.col("c_acctbal").alias("balance"), (F.col("o_totalprice") / 1000).alias("observed"),
        )
    )


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).join(arms(spark, d), "sample_id", "left")


ARMS_SQL = "arms AS (SELECT l_orderkey AS sample_id, sum(l_extendedprice) / 1000 AS a, sum(l_extendedprice * (1 - l_discount)) / 1000 AS b, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1000 AS c FROM lineitem GROUP BY 1)"
SAMPLES_SQL = """samples AS (SELECT o_orderkey AS sample_id, n_name AS region_id, o_orderstatus AS phase, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS utc_day, strftime(o_orderdate, '%Y-%m') AS month,
  CAST(quarter(o_orderdate) AS INT) AS quarter, o_custkey AS acquisition_id, o_orderpriority AS surface, c_mktsegment AS product, c_acctbal AS balance, o_totalprice / 1000 AS observed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PREDICTED_SQL = f"{ARMS_SQL}, {SAMPLES_SQL}, predicted AS (SELECT samples.*, a, b, c FROM samples LEFT JOIN arms USING (sample_id))"


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value by type and hour: an hourly series with gaps."""
    return load(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))


HOURLY_SQL = "hourly AS (SELECT event_type AS key, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cells of a grid 50 wide, 100 m apart."""
    p = load(spark, d, "part").withColumns({"row": F.expr("CAST(p_partkey div 50 AS INT)"), "col": F.expr("CAST(p_partkey % 50 AS INT)")})
    return p.select("row", "col", (F.col("col") + 0.5).alias("cx"), ((F.col("col") + 0.5) * 100).alias("x"), ((F.col("row") + 0.5) * 100).alias("y"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


GRID_SQL = "grid AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, (p_partkey % 50 + 0.5) * 100 AS x, (p_partkey // 50 + 0.5) * 100 AS y, p_retailprice AS value, p_size AS size, p_brand AS brand FROM part)"


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stations with a place from their key."""
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("station_id"), (F.pmod(F.col("s_suppkey") * 7919, F.lit(1200)) / 10.0 - 60).alias("lat"), (F.pmod(F.col("s_suppkey") * 104729, F.lit(3600)) / 10.0 - 180).alias("lon"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_name").alias("area_id"), (F.pmod(F.col("n_nationkey") * 523, F.lit(1100)) / 10.0 - 55).alias("lat"), (F.pmod(F.col("n_nationkey") * 1301, F.lit(3600)) / 10.0 - 180).alias("lon"))


STATIONS_SQL = "stations AS (SELECT s_suppkey AS station_id, s_suppkey * 7919 % 1200 / 10.0 - 60 AS lat, s_suppkey * 104729 % 3600 / 10.0 - 180 AS lon FROM supplier)"
AREAS_SQL = "areas AS (SELECT n_name AS area_id, n_nationkey * 523 % 1100 / 10.0 - 55 AS lat, n_nationkey * 1301 % 3600 / 10.0 - 180 AS lon FROM nation)"
