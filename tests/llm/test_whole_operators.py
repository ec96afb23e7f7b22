"""Language ID, near-duplicates and decontamination on cases that leave nothing out."""

import random

import numpy as np
import pyarrow as pa

from strataframe.llm import decontam, dedup, langid

from .test_text_operators import brute_components, families, frame, overlap


def test_every_language_is_learned_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = []
    for k in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", 5)
        rows += [(100 * k + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(60)), f"l{k}", "s") for i in range(8)]
    model = langid.fit(frame(spark, rows), steps=1)
    assert model.langs == sorted(f"l{k}" for k in range(70))
    some = [r for r in rows if r[0] < 300]
    first, again = (langid.identify(frame(spark, some).repartition(n), steps=40).orderBy("doc_id").collect() for n in (1, 5))
    assert first == again


def test_the_sample_is_bounded_and_covers_whole_texts(spark):
    """Copies of one row count once, and the windows of a chosen text are all there where the draws would reach them."""
    rows = [(i, f"text number {i} " * 30, "en", "s") for i in range(300)] + [(7, "the same row " * 30, "en", "s")] * 200 + [(1000, "short", "de", "s")]
    got = langid.sample(frame(spark, rows).select("doc_id", "text", "lang"), 20, 400)
    assert sum(lang == "en" for lang, _ in got) == 20 and ("de", 1) in {(lang, len(w) // (langid.WINDOW + langid.TAIL)) for lang, w in got}
    assert all(len(w) // (langid.WINDOW + langid.TAIL) >= 3 for lang, w in got if lang == "en")


def test_what_the_driver_gets_does_not_grow_with_texts_or_languages(spark):
    draws, size = 500, langid.WINDOW + langid.TAIL
    rows = [(1000 * k + i, f"{k} {i} " * 60_000 if i == 0 else f"{k} word{i} " * 40, f"l{k}", "s") for k in range(60) for i in range(30)]
    got = langid.sample(frame(spark, rows).select("doc_id", "text", "lang"), 400, draws)
    assert {lang for lang, _ in got} == {f"l{k}" for k in range(60)} and sum(len(w) // size for _, w in got) <= 3 * draws
    long = [(1, "a word of the long one " * 50_000, "en", "s"), (2, "ein Wort und noch eines", "de", "s")]
    ends = langid.sample(frame(spark, long).select("doc_id", "text", "lang"), 10, 100)
    assert sorted((lang, len(w) // size) for lang, w in ends) == [("de", 1), ("en", 50)]


def test_a_very_long_text_is_predicted_in_bounded_memory():
    """Windows of a text of 100 MB are known by place, and their codes made a part at a time."""
    import resource

    raw = np.frombuffer(b"some words of a text " * 5_000_000, np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = langid.windows(np.array([0, len(raw)]))
    total = sum(int(found.codes(raw, slice(lo, lo + 2048)).astype(bool).sum()) for lo in range(0, len(found.owner), 2048))
    assert total >= 80_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_pair_tables_give_the_plain_convolution():
    rng = np.random.default_rng(3)
    total = langid.FILTERS * len(langid.WIDTHS)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.N_CODES, langid.EMBED)), [rng.normal(size=(w * langid.EMBED, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=total), rng.normal(size=(total, 3)) / 8, rng.normal(size=3))
    texts = ["", "a", "Some WORDS in Ünïcode " * 12, "x" * langid.WINDOW, "日本語テキスト" * 30]
    raw, offsets = langid.text_buffers(pa.array(texts))
    found = langid.windows(offsets)
    codes, owner = found.codes(raw, slice(None)), found.owner
    got = langid.probabilities(model, langid.pair_tables(model), codes)
    place = 0
    for k, text in enumerate(texts):
        raw = [int(langid.CODES[b]) for b in text.encode()]
        for lo in range(0, len(raw), langid.WINDOW):
            own = np.array((raw[lo:] + [0] * (langid.WINDOW + langid.TAIL))[: langid.WINDOW + langid.TAIL])
            assert owner[place] == k and (codes[place] == own).all()
            pooled = [max(float(np.concatenate([model.embedding[c] for c in own[i : i + w]]) @ f[:, j]) for i in range(langid.WINDOW)) for w, f in zip(langid.WIDTHS, model.filters) for j in range(langid.FILTERS)]
            logits = np.maximum(np.array(pooled) + model.bias, 0) @ model.weights + model.offset
            p = np.exp(logits - logits.max())
            assert np.abs(got[place] - p / p.sum()).max() < 1e-3
            place += 1
    assert place == len(codes)


def test_hot_keys_and_shared_ids(spark, monkeypatch):
    """The same groups where most keys are hot, and where they may not be broadcast; an id that two texts share links nothing."""
    rows = families(seed=8, n=25)
    want = brute_components(rows)
    monkeypatch.setattr(dedup, "SIDE", 2)
    for most in (1_000_000, 0):
        got = dedup.near_duplicates(frame(spark, rows), broadcast_rows=most).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, n, c) for i, (n, c) in want.items()}
    two = [(5, "a b c d e f g", "en", "s"), (5, "h i j k l m n", "en", "s"), (3, "h i j k l m n", "en", "s"), (9, "A b c d e f g", "en", "s"), (9, "z", "en", "s"), (1, "other words that stand alone", "en", "s")]
    got = dedup.near_duplicates(frame(spark, two)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 5, True), (9, 1, 9, True), (9, 3, 5, False)]
    assert dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_with_hubs_split_and_not(spark):
    rng = random.Random(6)
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in {x for p in pairs if p[0] != p[1] for x in p}}
    links = spark.createDataFrame(pairs, "a long, b long")
    for split in (0, 10**9):
        assert {r.id: r.component for r in dedup.components(links, split_links=split).collect()} == want


def test_items_in_classes_short_ones_and_scripts_without_spaces(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    cjk = "これは試験のための長い文章であり空白を含まない"
    docs = [(1, f"before {passage} after", "en", "s"), (2, f"前の文。{cjk}。後の文", "ja", "s"), (3, "well what is the largest moon of saturn please", "en", "s"), (4, "what is the largest moon of mars", "en", "s"), (5, "ประเทศ" + "การทดสอบภาษาไทยที่ไม่มีช่องว่าง" + "จบ", "th", "s")]
    items = [(10, passage), (11, passage.upper()), (12, cjk), (13, "What is the largest moon of Saturn?"), (14, "too short"), (15, "การทดสอบภาษาไทยที่ไม่มีช่องว่าง")]
    got = overlap(spark, docs, items)
    assert set(got) == {(1, 10), (2, 12), (3, 13), (5, 15)}
    assert got[1, 10] == (1, 20, 20) and got[3, 13][1:] == (7, 7)
    short = [(20, "Saturn"), (21, "moon of Mars"), (22, "largest moon"), (23, "of mars moon"), (24, "..."), (25, ""), (26, None), (27, "what is the largest moon")]
    got = overlap(spark, docs, short)
    assert got == {(3, 20): (7, 1, 1), (4, 21): (4, 3, 3), (3, 22): (4, 2, 2), (4, 22): (3, 2, 2), (3, 27): (1, 5, 5), (4, 27): (0, 5, 5)}
    assert decontam.decontaminate(frame(spark, docs), spark.createDataFrame(short, "item_id long, text string"), least_words=6).count() == 0


def test_a_seed_that_many_items_share(spark):
    """Three hundred items begin alike; every document that holds one is found with that one."""
    lead = "one two three four five six seven eight"
    items = [(i, lead + " " + " ".join(f"i{i}w{k}" for k in range(12))) for i in range(300)]
    docs = [(i, f"d{i} " * 5 + (items[i][1] if i < 100 else lead) + " end", "en", "s") for i in range(200)]
    got = overlap(spark, docs, items)
    assert set(got) == {(i, i) for i in range(100)}
