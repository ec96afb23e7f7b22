"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """UTC times, adaptive execution with skewed joins split, strict casts."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.ansi.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    return (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else builder).getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table with every zoneless time taken as UTC. A cast of a column keeps filters and pruning on the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in zoneless}) if zoneless else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so that aggregates leave it out."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
