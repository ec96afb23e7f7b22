"""Operators over documents: against brute force, and on odd rows."""

import collections
import random
import re
import zlib

import pytest

from strataframe.llm import decontam, dedup, langid, lm, mixing, pii, quality, queries, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, words string, held_out int, component_id string, row int, id int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "  \t\n ", None, "s"), (4, "123 456", "xx", None), (5, "One two three four five six", "en", "t"),
    (5, "One two three four five six", "en", "t"), (None, "no id here at all", "en", "t"), (7, LONG, "en", "big"), (8, LONG + " tail", None, "big"),
    (9, "日本語 テキスト です", "ja", "s"), (10, "a b a b a b a b", "en", "s"), (11, "x" * 50_000, None, "s"), (12, "\x0b\x0c\x1c", "en", "s"), (13, "🙂 astral 𝒜", "en", "s"),
]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, "clash", 3, "clash", 9, 9) for r in rows], schema)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def families(seed=3, n=60):
    """Documents in families of copies, from exact to just below the threshold, plus a shared passage."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=60)
    docs = []
    for f in range(n):
        words = rng.choices(vocab, k=rng.choice([3, 30, 150, 400]))
        for c in range(rng.choice([1, 1, 2, 6])):
            w = list(words)
            for _ in range(int(len(w) * rng.choice([0, 0, 0.005, 0.01, 0.015, 0.02, 0.03]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if f % 5 == 0:
                w += passage
            docs.append(" ".join(x.upper() if c % 2 else x for x in w))
    rng.shuffle(docs)
    return [(i * 3 + 1, t, "en", "s") for i, t in enumerate(docs)]


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = families() + [r for r in ODD if r[0] not in (None,)]
    rows = [(i + 1000 * (k >= len(rows) - len(ODD) + 1), *r) for k, (i, *r) in enumerate(rows)]
    got = [r.asDict() for r in dedup.near_duplicates(frame(spark, rows)).collect()]
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, n, c) for i, (n, c) in want.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_links_that_no_centre_has_are_found(spark):
    """A chain: neighbours are close, ends are not, so most pairs of a key are not linked directly."""
    rng = random.Random(9)
    words = [f"q{i}" for i in range(300)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(words), "en", "s"))
        for j in rng.sample(range(300), 3):
            words[j] = f"n{i}_{j}"
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}
    assert set(got.values()) == {0}


def test_null_id_is_kept_without_component(spark):
    got = dedup.near_duplicates(frame(spark, [(None, "some text of five words", "en", "s"), (1, "some text of five words", "en", "s")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True)}


def overlap(spark, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.doc_from, r.n_words, r.n_same) for r in decontam.decontaminate(frame(spark, docs), benchmark, **options).collect()}


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(4)
    vocab = [f"b{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([13, 20, 45])))) for i in range(30)]
    docs, planted = [], {}
    for i in range(60):
        filler = rng.choices(vocab, k=200)
        if i % 2 == 0:
            item = items[i // 2][1].split()
            changed = list(item)
            if len(item) >= 20:
                for j in rng.sample(range(len(item)), len(item) // 10):
                    changed[j] = "other"
            at = rng.randrange(200)
            filler[at:at] = [w.upper() + "," for w in changed]
            planted[i, i // 2] = at
        docs.append((i, " ".join(filler), "en", "s"))
    got = overlap(spark, docs, items)
    assert set(got) == set(planted)
    for pair, at in planted.items():
        assert abs(got[pair][0] - at) <= 3


def test_decontamination_matches_a_plain_comparison(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    tokens = lambda s: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(s or ""))
    want = set()
    grams = collections.defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    for d, t, *_ in docs:
        w = tokens(t)
        want |= {(d, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = overlap(spark, docs, items)
    assert want <= set(got) and len(got) <= len(want) + 2


def test_decontamination_of_odd_rows(spark):
    docs = [r for r in ODD if r[0] is not None]
    assert overlap(spark, docs, [(1, None), (2, ""), (3, "short item"), (4, " ".join(f"w{i}" for i in range(100, 130)))]) .keys() == {(7, 4), (8, 4)}
    assert overlap(spark, [], [(1, "a")]) == {} and overlap(spark, docs, []) == {}


def brute_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            bad = {"ip": lambda: max(map(int, m[0].split("."))) > 255, "card": lambda: not 13 <= len(digits) <= 19 or total % 10, "phone": lambda: not 9 <= len(digits) <= 15}
            if not bad.get(kind, lambda: False)():
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "0123456789.- +()", "12. ", "+1 -.()5a", "@ab.@", "4111 1111-1+"])
def test_spans_match_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.find(text)[0] == brute_spans(text), text


def test_personal_data_of_whole_tables(spark):
    docs = frame(spark, [*ODD, (20, "mail a.b@c.de, card 4111 1111 1111 1111, token = \"abc123def456\" and DE89 3704 0044 0532 0130 00 IBAN: DE89 3704 0044 0532 0130 00.", "en", "s")])
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert got[20].n_email == 1 and got[20].n_card == 1 and "iban:" in got[20].spans and "account:" in got[20].spans
    assert (got[1].n_email, got[1].spans) == (0, "") and got[7].n_card == 0
    assert pii.scan(frame(spark, [])).count() == 0
    assert pii.redact_text("to a@b.cd now") == "to [EMAIL] now"
    assert pii.find("call +1 (826) 555-4081 190.137.2.9 ok")[1] == [("phone", 5, 22)]
    assert pii.find("4111 1111 1111 1111 2027 12")[1] == [("card", 0, 19)]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "1-" * 150_000):
        pii.find(text)


def test_token_counts_match_the_library(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(2)
    odd = [chr(c) for c in (9, 10, 13, 28, 31, 32, 32, 32, 0x85, 0xA0, 0x2003, 0x200B, 0x3000)] + [*"ab1'st’rélü中文٣²Ⅷ_-.\"!", "'re", "'LL", " 's", "<|endoftext|>", "<|endof", "🙂", "𝒜"]
    rows = ODD + [(100 + i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 14))), "en", "s") for i in range(3000)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(frame(spark, rows), path, hot=50).collect())
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or 0, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert tokencount.count_tokens(frame(spark, []), path).count() == 0


def unigram(rows):
    words = lambda t: [*WORD.findall(lower(t or "")), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    import math

    return {(i, t): (held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows}


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_language_model_base_scores(spark, monkeypatch, hot):
    rows = [(r[0], r[1], r[2], r[3]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(i and 10_000 + i, *r) for i, *r in ODD]
    monkeypatch.setattr(lm, "vocabulary", lambda counts, f=lm.vocabulary: f(counts, hot))
    got = lm.score(frame(spark, rows), rounds=1).collect()
    want = unigram([r[:2] for r in rows])
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id, texts[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0


def flat_vocabulary(n):
    import numpy as np

    return lm.Vocabulary(*[np.zeros(0)] * 4, 0, 0, 1, np.ones(n), n, True)


def test_language_model_is_a_distribution():
    """Probabilities of all next words after any history add up to 1, and training raises the likelihood."""
    import numpy as np

    rng = np.random.default_rng(0)
    size = lm.WORDS + 1
    vector = lm.initial(flat_vocabulary(size))
    states = rng.normal(size=(3, lm.HIDDEN)).astype(np.float32)
    for s in states:
        logs, _ = lm.Net(vector).outputs(np.repeat(s[:, None], size, 1), np.arange(size))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    places = np.tile([5, 9, 700, 1], 500)
    ptr = np.arange(0, 2001, 4)
    before = lm.log_probabilities(lm.Net(vector), places, ptr).sum()
    moments = np.full_like(vector, 1e-4)
    for _ in range(5):
        lm.learn(vector, places, ptr, moments, 0.1)
    assert lm.log_probabilities(lm.Net(vector), places, ptr).sum() > before / 4


def plain_log_probabilities(net, places, ptr):
    """Word by word, with nothing but the definition."""
    import numpy as np

    h, out = lm.HIDDEN, []
    for a, b in zip(ptr[:-1], ptr[1:]):
        state = np.zeros(h)
        for t in range(a, b):
            x, u = net.inputs[places[t - 1]], net.recur @ state
            z, r = (np.clip(0.25 * (x[k : k + h] + u[k : k + h]) + 0.5, 0, 1) for k in (0, h))
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :])
            kinds = net.to_class @ state + net.class_bias[:, 0]
            kind = -(-places[t] // lm.PER_CLASS)
            p = kinds[kind] - np.log(np.exp(kinds).sum())
            if kind:
                words = state @ net.to_word[kind - 1] + net.word_bias[kind - 1]
                p += words[(places[t] - 1) % lm.PER_CLASS] - np.log(np.exp(words).sum())
            out.append(p)
    return np.array(out)


def test_network_matches_a_plain_one():
    """State runs through documents longer than a window, whatever stands beside them."""
    import numpy as np

    rng = np.random.default_rng(4)
    vector = (lm.initial(flat_vocabulary(lm.WORDS + 1)) + rng.normal(0, 0.1, len(lm.initial(flat_vocabulary(lm.WORDS + 1))))).astype(np.float32)
    ptr = np.concatenate([[0], np.cumsum([1, 40, 3, 150, 1, 1, 70])])
    places = rng.integers(0, lm.WORDS + 1, ptr[-1])
    places[ptr[1:] - 1] = 1
    assert np.abs(lm.log_probabilities(lm.Net(vector), places, ptr) - plain_log_probabilities(lm.Net(vector), places, ptr)).max() < 1e-3


def test_gradients_match_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    vocab = flat_vocabulary(lm.WORDS + 1)
    vector = (lm.initial(vocab) + rng.normal(0, 0.05, len(lm.initial(vocab)))).astype(np.float32)
    places, ptr = rng.integers(0, lm.WORDS + 1, 30), np.array([0, 12, 30])
    places[[11, 29]] = 1
    loss = lambda v: -lm.log_probabilities(lm.Net(v.astype(np.float32)), places, ptr).mean()
    moved, moments = vector.copy(), np.zeros_like(vector)
    lm.learn(moved, places, ptr, moments, 0.0, least_window=64)
    gradient = np.sqrt(moments)
    for at in np.argsort(-gradient)[[0, 3, 10, 40]]:
        up, down = vector.copy(), vector.copy()
        up[at] += 0.02
        down[at] -= 0.02
        assert abs(loss(up) - loss(down)) / 0.04 == pytest.approx(gradient[at], rel=0.05, abs=2e-3)


def test_language_model_gains_on_held_out_documents_however_rows_lie(spark):
    """At least a tenth of a decimal place a token better than single words' counts; the same after a new partitioning."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, again = (lm.score(d, shard_tokens=1 << 16).toPandas() for d in (docs, docs.repartition(7)))
    held = first[first.held_out]
    assert held.score.sum() - held.base_score.sum() > 0.1 * held.n_tokens.sum() > 0
    both = first.merge(again, on=["doc_id", "n_tokens", "n_known", "base_score"])
    assert len(both) >= len(first) and (both.score_x - both.score_y).abs().max() < 1e-2


def test_language_model_of_odd_tables(spark):
    assert lm.score(frame(spark, [])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    alone = lm.score(frame(spark, [(i, "never learned", "en", "s") for i in held])).collect()
    assert len(alone) == len(held) > 0 and all((r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.score < 0 for r in alone)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    got = collections.defaultdict(list)
    for r in langid.identify(frame(spark, ODD), steps=20).collect():
        got[r.doc_id].append((r.lang_pred, r.held_out))
    for i in (1, 2, 3, 4, 12):
        assert {p for p, _ in got[i]} == {"und"}
    assert all(p != "und" for i in (5, 7, 9, 11) for p, _ in got[i])
    assert all(h == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, v in got.items() for _, h in v)
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(frame(spark, [(i, "some text", None, "s") for i in range(9)])).collect()} == {"und"}


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), "en", s) for i in range(900) for s in [rng.choice(["a"] * 8 + ["b", "c", None])]] + ODD
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    sources = collections.defaultdict(set)
    for i, _, _, s in rows:
        sources[i].add(s)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert sum(r.taken for r in got) == pytest.approx(total, abs=len(by))
    for (size, target), docs in by.items():
        assert target <= 3 * size + 1e-6
        if len({(r.source_size) for r in docs}) == 1 and sum(r.size for r in docs) == size:
            assert sum(r.taken for r in docs) == pytest.approx(target, abs=1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(7)).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_rows_without_an_id_or_with_the_same_one(spark, monkeypatch):
    """They are spread by their texts; equal rows are one row with a count, and come out as often as they go in."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, f"w{i} " * (i % 9), "en", "a") for i in range(2000)] + [(5, "same words here", "en", "a")] * 1500 + [(i, "x y", "en", "b") for i in range(100)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(t.split())) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.target].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert len(by) == 2 and all(sum(r.taken for r in docs) == pytest.approx(target, abs=1) for target, docs in by.items())
    assert len({r.taken for r in got if r.doc_id == 5}) <= 3  # before, at and after the cut


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped, out = sum(sizes.values()), set(), dict.fromkeys(names, 0.0)
    excess = float(total)
    while excess > 1e-9:
        free = [s for s in names if s not in stopped]
        share = sum(w[s] for s in free)
        for s in free:
            out[s] += excess * w[s] / share
        excess = 0.0
        for s in free:
            if out[s] > most * sizes[s]:
                excess += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                stopped.add(s)
    return out


def test_targets_match_resharing(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {s: rng.choice([0, 3, 50, 1000, 9000]) for s in rng.sample(["a", "B", "é", "z", "", None, "ab"], rng.randint(1, 7))}
        frame_ = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame_, (1, 2, 3), 3).collect()}
        for s, t in brute_targets(sizes).items():
            assert got[s] == pytest.approx(t, abs=1e-6), sizes


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rng = random.Random(5)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "b", " ", "\n", "#", " c ", "\t", "é<"]) for _ in range(rng.randint(0, 150))), "en", rng.choice("xyz")) for i in range(400)]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.host_rules(frame(spark, rows)).collect()}
    assert got == {(i, *brute_quality(t)) for i, t, *_ in rows}
    assert quality.host_rules(frame(spark, [])).count() == 0


def test_a_host_of_failing_pages_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 10 or i < 500 else "bad", "en", f"h{i % 20}") for i in range(600)] + [(1000 + i, "junk " * 60 if i else good, "en", "farm") for i in range(200)]
    got = quality.host_rules(frame(spark, rows)).collect()
    assert {r.host for r in got if r.host_verdict == "reject"} == {"farm"}
    assert all(r.kept == (not r.base_failed and r.host != "farm") for r in got)
    assert any(not r.base_failed and not r.kept for r in got)
