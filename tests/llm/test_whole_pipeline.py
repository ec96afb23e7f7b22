"""The pipeline's stages link copies from 80 % on and decide repeated rows and rows without doc_id."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm import dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_signatures_find_pairs_at_the_threshold():
    for percent, form in dedup.LAYOUTS.items():
        p = (1 - percent / 100) * (1 - 2.0**-dedup.BITS)
        missed = sum(math.comb(form.symbols, k) * p**k * (1 - p) ** (form.symbols - k) for k in range(form.distance + 1, form.symbols + 1))
        assert missed < 1 / 60_000


def test_near_copies_repeated_rows_and_rows_without_id(spark):
    words = [f"w{i}" for i in range(200)]
    changed = [f"x{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]  # 176 of 216 shingles in common
    twice = " ".join(f"v{i}" for i in range(100))
    same = " ".join(f"u{i}" for i in range(100))
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, twice), (3, twice), (4, same), (None, same), (None, "quite another text with some words")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, rows[0][1]), (3, twice), (4, same), (0, rows[-1][1])])


def test_contaminated_row_without_id_goes(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (None, "nothing of the benchmark is here"), (5, item)]
    got = corpus_pipeline.decontamination(spark, frame(spark, rows), SF).collect()
    assert [(r.doc_id, r.text) for r in got] == [rows[1]]


def test_empty_tables_and_clashing_columns(spark):
    """Each stage keeps the columns it got, whatever their names, and an empty table stays empty."""
    rows = frame(spark, [(1, "some words of a text that is long enough for a language to be told"), (2, "zwei Worte und noch einige mehr, damit die Sprache erkennbar ist")])
    for docs in (rows.limit(0), rows.withColumns({c: F.lit(1) for c in ("row", "id", "key", "component_id", "size", "set_a", "row_a", "spans", "__row_key__", "___row_key__")}), rows.drop("n_chars").withColumn("a.b", F.lit(2))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            assert name == "mixing" or out.columns == docs.columns
            assert name == "mixing" or "__row_key__" not in docs.columns or {r["__row_key__"] for r in out.collect()} <= {1}
