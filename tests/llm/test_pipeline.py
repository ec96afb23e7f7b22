"""The pipeline's stages, each held against a brute-force version of its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm import pii
from strataframe.llm.store import written

from .test_text_operators import WORD, brute_components, brute_spans, overlap

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "src0", 0), (90_003, "12 34", None, "src1", 5)], docs.schema)
    docs = written(docs.unionByName(odd), "in")
    columns = docs.columns
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        if name != "mixing":
            assert out.columns == columns
        if name == "language_id":
            assert not {90_001, 90_002, 90_003} & set(after) and len(after) >= 0.97 * (len(before) - 3)
        elif name == "near_dedup":
            want = brute_components([(i, r.text) for i, r in before.items()], corpus_pipeline.NEAR_PERCENT)
            assert set(after) == {c for _, c in want.values()} and len(after) < len(before)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {i for i, _ in overlap(spark, [(r.doc_id, r.text, r.lang, r.source) for r in before.values()], items)}
            assert leaked and set(after) == set(before) - leaked
        elif name == "pii":
            changed = 0
            for i, r in after.items():
                assert r.text == pii.redact_text(before[i].text) and r.n_chars == len(r.text)
                assert not brute_spans(r.text) or r.text == before[i].text or not pii.find(r.text)[0]
                changed += r.text != before[i].text
            assert set(after) == set(before) and changed
        else:
            sizes = {i: len(WORD.findall(r.text or "")) for i, r in before.items()}
            assert all(r["size"] == sizes[i] and 0 < r.taken <= 3 * r["size"] for i, r in after.items())
            assert abs(sum(r.taken for r in after.values()) - sum(sizes.values())) <= len({r.source for r in before.values()})
        state[name] = len(after)
        docs = out
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.filter(F.col("taken") <= 0).count() == 0
    assert got.count() > 0
