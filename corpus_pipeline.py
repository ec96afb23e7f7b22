"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's documents. Stages that reject documents decide each row by a key of its own content, whatever its doc_id: a
document may have none, or one that others have too. All stages but the last return the columns of documents; the last
returns the mix: doc_id, size, source_size, target, taken for each document that it takes.

Defined results: a null text, an empty one or one without a letter goes in the first stage; rows that are equal throughout
are one document, of which near_dedup keeps one row; of near copies the smallest doc_id stays, a row without one only where
no other has one; a null source is a source of its own; personal data in a null text is none; extra columns pass through all
stages but the last, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontam, dedup, langid, mixing, pii
from strataframe.llm.store import written

#: A document is rejected if no language was recognised or none reached this share.
MIN_LANGUAGE_SCORE = 0.35
#: Near copies have at least this percentage of their five-word shingles in common.
NEAR_PERCENT = 80
#: A benchmark item with fewer words says too little to reject a document for.
LEAST_ITEM_WORDS = 6
#: The column that tells rows apart, and what is put before its name while a table has a column of that name.
KEY, MORE = "__row_key__", "_"


def _keyed(docs: DataFrame) -> DataFrame:
    """With 128 bits of a hash of all of a row's values, nulls told apart. A column of the key's name gets another one."""
    values = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    key = F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(k), *values)) for k in (0, 1)))
    aside = KEY
    while aside in docs.columns:
        aside = MORE + aside
    return docs.select(*(F.col(f"`{c}`").alias(aside if c == KEY else c) for c in docs.columns), key.alias(KEY))


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs of rows that were keyed."""
    names = dict(zip((c for c in rows.columns if c != KEY), docs.columns, strict=True))
    return rows.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))


def _few(rows: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Written rows, to be broadcast if counted to be few enough."""
    rows = written(rows, "rejected")
    return F.broadcast(rows) if rows.count() <= broadcast_rows else rows


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among keys (KEY, distinct)."""
    return rows.join(_few(keys), KEY, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    rows = _keyed(docs)
    found = langid.identify(rows, id_col=KEY).filter((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE))
    return _without(rows, found.select(F.col("doc_id").alias(KEY)).distinct()).transform(_as_before, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest number (those without one come last)."""
    rows = _keyed(docs)
    found = written(dedup.near_duplicates(rows, id_col=KEY, percent=NEAR_PERCENT).select(F.col("doc_id").alias(KEY), "component_id"), "copies")
    others = found.filter(F.col(KEY) != F.col("component_id")).distinct()
    heads = others.select(F.col("component_id").alias(KEY), "component_id").distinct()
    members = written(rows.select(KEY, "doc_id").distinct().join(written(others.union(heads), "members"), KEY), "named")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("first"))
    kept = _without(rows, members.join(_few(first), "component_id").filter(F.col(KEY) != F.col("first")).select(KEY))
    again = _few(found.groupBy(KEY).count().filter("count > 1").select(KEY))
    return kept.join(again, KEY, "left_anti").union(kept.join(again, KEY, "left_semi").dropDuplicates([KEY])).transform(_as_before, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    return _without(rows, decontam.decontaminate(rows, benchmark, id_col=KEY, least_words=LEAST_ITEM_WORDS).select(F.col("doc_id").alias(KEY)).distinct()).transform(_as_before, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    rows = pii.redacted(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights; documents that the mix doesn't take go."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mix)]

#: The stages learn a model and hash signatures, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
