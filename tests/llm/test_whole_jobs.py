"""Operators do the whole of their job: nothing is left out by a sample, a level, a window or a filter."""

from pyspark.sql import functions as F

from strataframe.llm import lm

from .test_text_operators import frame


def test_language_model_learns_from_every_training_document(spark):
    ids = [r.id for r in spark.range(400).filter((F.pmod(F.xxhash64("id"), F.lit(8)) != 0) & ~lm.held_out(F.col("id"), 10)).limit(40).collect()]
    rows = [(i, "one two three four five six " * 30, "en", "s") for i in ids]
    sums = [lm.score(frame(spark, rows), rounds=n).agg(F.sum("score")).first()[0] for n in (0, 2)]
    assert len(ids) == 40 and sums[1] > sums[0]
