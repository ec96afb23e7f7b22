"""Substring deduplication against a plain comparison of all windows, hot minimisers and odd rows included."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strataframe.llm import substrings

from .test_text_operators import LONG, ODD, WORD, frame


def brute(rows, length=35):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, *_), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **options):
    return sorted(map(tuple, substrings.digests(frame(spark, rows), **options).collect()), key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    shared = [rng.choices(vocab, k=k) for k in (34, 35, 36, 60, 200, 700)]
    docs = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([0, 10, 34, 35, 90, 400]))
        for passage in rng.sample(shared, k=rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            cut = rng.choice([0, 0, 1, len(passage) // 3])
            words[at:at] = passage[cut:]
        if i % 10 == 0:
            words += words  # repeats itself
        gap = rng.choice([" ", "  ", "\n", "\t \n"])
        docs.append((i, gap.join(words), "en", "s"))
    loops = [(1000, "a b c " * 50, "en", "s"), (1001, "x " * 100, "en", "s"), (1002, "x " * 35, "en", "s"), (1003, "x " * 34 + "y", "en", "s"), (1004, "X " * 40, "en", "s")]
    return docs + loops + docs[:3] + [(2000, docs[4][1], "en", "s")]


@pytest.mark.parametrize("options", [{}, {"length": 12, "gram": 4}, {"length": 7, "gram": 7}, {"length": 2, "gram": 1}])
def test_every_window_counts(spark, options):
    rows = corpus()
    found = result(spark, rows, **options)
    assert found == brute(rows, options.get("length", 35)) and any(r[2] for r in found) and any(r[1] and not r[2] for r in found)


@pytest.mark.parametrize("most_told", [0, 10**6])
def test_hot_minimisers(spark, most_told):
    """With so low a bound most shared passages are hot; their windows are told to all tasks, or joined."""
    rows = corpus(2)
    assert result(spark, rows, least_hot=2, most_told=most_told) == brute(rows)


def test_a_passage_in_half_of_the_documents(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) + (" " + passage if i % 2 else "") + f" tail{i} " * 20, "en", "s") for i in range(3000)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = ODD + [(None, LONG[:5000], "en", "s"), (None, LONG[:5000], "en", "s")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        result(spark, rows, length=3, gram=4)


def test_windows_of_one_hash_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(substrings, "ngrams", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    strings = pa.array([b"a b c", b"b c d", b"x b c", b"b d"], pa.binary())
    assert substrings.repeated_windows(strings, 2).tolist() == [2, 1, 2, 0]


def test_packed_strings_hold_their_windows():
    rng = np.random.default_rng(4)
    hashes, ptr = rng.integers(1, 50, 4000).astype(np.uint64), np.array([0, 10, 10, 1500, 4000])
    least = substrings.minimisers(hashes, ptr, 35, 6).least
    grams = substrings.ngrams(hashes, 6)
    for i in range(len(least)):
        ends = next(e for e in ptr[1:] if i < e)
        assert least[i] == (grams[i : i + 30].min() if i + 35 <= ends else 0)
    runs = substrings.stretches(least)
    covered = [b + k for b, n in zip(runs.begin, runs.windows, strict=True) for k in range(n)]
    assert covered == np.flatnonzero(least).tolist() and runs.windows.max() <= substrings.STRETCH
