"""Structured Streaming forms of batch operators: screening with the last report kept, enrichment, full hourly windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_reason, floor_hour, passes
from ..store import new_path


def screened_latest(stream: DataFrame, rules: Sequence[tuple[Column, str]], key: str, ts: str, received: str, value: str, late: str = "90 minutes") -> DataFrame:
    """Rejected reports fall away by ordered checks; of those of one key and time the last received stays."""
    good = stream.withColumn("reason", first_reason([(~passes(c), label) for c, label in rules])).filter("reason IS NULL")
    return good.withWatermark(ts, late).groupBy(key, ts).agg(F.max_by(value, received).alias(value), F.count(F.lit(1)).alias("reports"))


def enriched(stream: DataFrame, hourly: DataFrame, key: str, ts: str, values: Sequence[str]) -> DataFrame:
    """Stream against a static hourly table: the hour that each time lies in."""
    right = hourly.select(F.col(key).alias("__k"), F.col("hour").alias("__h"), *values)
    return stream.join(right, (F.col(key) == F.col("__k")) & (floor_hour(F.col(ts)) == F.col("__h")), "left").drop("__k", "__h")


def full_hours(stream: DataFrame, key: str, ts: str, value: str, hours: int, late: str = "2 hours") -> DataFrame:
    """Sums over the last ``hours`` hours of a series; a window gives null unless each of its hours has a value. The hours
    seen are a set of at most ``hours`` members in the state."""
    w = F.window(ts, f"{hours} hours", "1 hour")
    seen = F.size(F.collect_set(F.when(F.col(value).isNotNull(), floor_hour(F.col(ts)))))
    return stream.withWatermark(ts, late).groupBy(w, key).agg(seen.cast("long").alias("valid_hours"), F.sum(value).alias("__s")).select(key, F.col("window.end").alias("window_end"), "valid_hours", F.when(F.col("valid_hours") == hours, F.col("__s")).alias("total"))


def drained(stream: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """All that is there now, through the stream, as a table of files in the shared folder. Results that later batches
    replace (``keys`` given) are kept by batch, the latest of a key counts; state goes as the watermark passes."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if not keys:
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("__batch", "long")).option("recursiveFileLookup", "true").parquet(out)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("__v")).select(*keys, "__v.*")
