"""Mixing sources to target weights.

Every document gets a hash-random key of its id and text; documents of a source are ordered by it, a distributed prefix sum of their token
counts is taken, and the mix is cut at the source's exact budget, whole epochs first. DataFrame functions only.

The prefix sum has two levels: the key's leading bits deal a source's documents evenly into ``buckets``, whose totals
(a bounded number a source) give each bucket's offset, and the running sum inside a bucket needs only that bucket's rows.
So a source that holds a third of all rows is spread over as many tasks as any other data, and no text is shuffled. Sources
themselves are ranked and levelled in one task, a row each: they are kinds of data, thousands at most, not hosts.

Defined results: a null or empty text has size 0 and is taken 0 times; a source without words has target 0; null is a
source of its own, last in order; repeated rows count each for itself (rows of one id and text are summed as one row with a
count before the running sum, however many they are, and come out one by one, so the rows of a rerun agree as a set); an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a row that come out of one array.
COPIES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row for each source of ``sizes`` (source, source_size): its target in words.

    Shares that exceed ``max_epochs`` times their source stop there and the excess goes to the others by weight. The end
    of that process is a common level times the weight for all that haven't stopped; sources in order of the level at
    which they stop give it from two running sums.
    """
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("double"))
        .withColumn("stop", F.lit(max_epochs) * F.col("source_size") / F.col("weight"))
    )
    before = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(max_epochs) * F.col("source_size")).over(before), F.lit(0)))
        / F.sum("weight").over(Window.orderBy("stop", "rank").rowsBetween(0, Window.unboundedFollowing)),
    )
    reached = F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))
    return levels.withColumn("level", F.min(reached).over(everything)["level"]).select(
        "source", "source_size", F.least((F.lit(max_epochs) * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, buckets: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    A source's taken words add up to its target rounded to a word; the document at the cut is taken in part.
    """
    id_text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    key = F.conv(F.substring(F.md5(id_text), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    keyed = written(sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "mix")
    keyed = keyed.withColumn("bucket", F.shiftright("key", 60 - buckets.bit_length() + 1).cast("int"))
    words = F.col("size") * F.col("copies")
    totals = keyed.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    targets = source_targets(keyed.groupBy("source").agg(F.sum(words).alias("source_size")), weights, max_epochs)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    # copies in parts of COPIES, so that no array is longer
    joined = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    last = F.least(F.col("copies") - F.col("part") * COPIES, F.lit(COPIES)) - 1
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("before") - (F.col("part") * COPIES + F.col("copy")) * F.col("size")))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST([1, 2, 3][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM r),
c AS (SELECT *, 3 * source_size / weight AS stop FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)
        - coalesce(sum(3 * source_size) OVER (ORDER BY stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY stop, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE),
        (SELECT level FROM l WHERE level <= stop ORDER BY stop, rank LIMIT 1) * weight) AS target FROM l),
d AS (SELECT sized.*, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM d)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
