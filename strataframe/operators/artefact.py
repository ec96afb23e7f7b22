"""A frozen model as files: saved once, known by a digest, checked before use, scored in whole batches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite, first_reason
from .contracts import ContractError

VERSION = 1


class Frozen(NamedTuple):
    model: PipelineModel
    features: list[str]
    category: str | None
    domain: list[str]
    label: str
    digest: str


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files under a path, by name and content; read by Spark, so any store will do."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", f"/{root}/", 2), -1)
    lines = files.filter(~F.col("path").rlike(r"/[_.][^/]*$")).select(F.concat_ws(":", name, F.sha2("content", 256)).alias("line"))
    found = lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]  # a model has some dozen files
    return found


def save(model: PipelineModel, spark: SparkSession, path: str, *, features: Sequence[str], label: str, category: str | None = None, domain: Sequence[str] = ()) -> str:
    """Writes the model with its contract under a new path; returns the digest that a later ``load`` has to be given."""
    contract = {"version": VERSION, "features": list(features), "category": category, "domain": sorted(domain), "label": label}
    model.save(f"{path}/model")
    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/contract")
    return digest(spark, path)


def load(spark: SparkSession, path: str, expected: str) -> Frozen:
    """The model at a path, if its files are those that ``expected`` was taken of and its contract is one that is known."""
    found = digest(spark, path)
    if found != expected:
        raise ContractError(f"the model under {path} isn't the one that was frozen: {found}")
    contract = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if contract.get("version") != VERSION:
        raise ContractError(f"unknown version of a model's contract: {contract.get('version')}")
    return Frozen(PipelineModel.load(f"{path}/model"), contract["features"], contract["category"], contract["domain"], contract["label"], found)


def score(frozen: Frozen, df: DataFrame, batch: Sequence[str], baseline: Column) -> DataFrame:
    """Adds offset, prediction (baseline plus offset), status and problem.

    A batch (rows alike in the columns ``batch``) with a feature that is not finite, a category outside the model's domain, or
    a result that is not finite, is refused as a whole: its rows stay, without a prediction, with the batch's first problem.
    Only the rows of good batches reach the model. A feature that the table lacks is an error.
    """
    missing = [c for c in [*frozen.features, *([frozen.category] if frozen.category else [])] if c not in df.columns]
    if missing:
        raise ContractError(f"the model needs {missing}")
    rules: list[tuple[Column, str]] = [(~F.coalesce(finite(F.col(c).cast("double")), F.lit(False)), f"invalid_{c}") for c in frozen.features]
    rules.append((~F.coalesce(finite(baseline.cast("double")), F.lit(False)), "invalid_baseline"))
    if frozen.category:
        rules.append((~F.coalesce(F.col(frozen.category).isin(*frozen.domain), F.lit(False)), f"unknown_{frozen.category}"))
    batch = list(batch)

    def refused(rows: DataFrame, problem: Column) -> DataFrame:
        """Rows with the first problem of their batch (null for none)."""
        marked = rows.withColumn("__problem", problem)
        of = marked.filter(F.col("__problem").isNotNull()).groupBy(batch).agg(F.min("__problem").alias("problem"))
        of = of.select(*(F.col(c).alias(f"__of_{c}") for c in batch), "problem")
        return rows.join(of, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in batch], "left").drop(*(f"__of_{c}" for c in batch))

    checked = refused(df, first_reason(rules))
    scored = frozen.model.transform(checked.filter(F.col("problem").isNull()).drop("problem"))
    scored = scored.select(*df.columns, F.col("prediction").alias("offset"))
    checked_again = refused(scored, F.when(~finite(F.col("offset") + baseline), "invalid_result"))
    good = F.col("problem").isNull()
    done = checked_again.select(*df.columns, F.when(good, F.col("offset")).alias("offset"), F.when(good, baseline + F.col("offset")).alias("prediction"), F.when(good, "predicted").otherwise("refused_batch").alias("status"), "problem")
    none = F.lit(None).cast("double")
    out = checked.filter(F.col("problem").isNotNull()).select(*df.columns, none.alias("offset"), none.alias("prediction"), F.lit("refused_batch").alias("status"), "problem")
    return done.union(out)
