"""Texts of any length are hashed in bounded memory; token counts go through both tiers."""

import random
import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa

from strataframe.llm import queries, tokencount, tokens

from .test_text_operators import frame


def word_hashes(text, **kw):
    return np.concatenate([b.hashes for b in tokens.blocks(pa.array([text]), **kw)])


def test_segments_do_not_change_hashes():
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choice("abZé日") for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(rng.randint(1, 40))]
        text = " " * rng.randint(0, 40) + (" " * rng.randint(1, 40)).join(words) + "\n" * rng.randint(0, 30)
        alone = np.array([word_hashes(w)[0] for w in words])
        for size in (16, 64, 100_000):
            assert (word_hashes(text, block_bytes=size) == alone).all()


def test_a_very_long_text_stays_small():
    """100 MB of words, and one word of 100 MB, each take under 500 MB beside the text."""
    code = """
import resource, sys, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from strataframe.llm import tokens
column = pa.array([("some words of " + "x" * 10 + " ") * 4_000_000 if sys.argv[2] == "words" else "y" * 100_000_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(b.hashes) for b in tokens.blocks(column))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    for kind, words in (("words", 16_000_000), ("one", 1)):
        out = subprocess.run([sys.executable, "-c", code, root, kind], capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) == words and int(out[1]) < 500_000
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 1_500_000


def library_count(path, text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_both_tiers(spark, monkeypatch):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    docs = frame(spark, [(i, "the the the cat sat 🙂 on 𝒜 mats" if i % 2 else "rare%d word the" % i, "en", "s") for i in range(40)])
    tier = tokencount.frequent(docs, path, "text", 6)
    assert set(tier) == {" the", "the", " cat", " sat", " on", " mats"} or len(tier) == 6 and " the" in tier
    assert all(n == library_count(path, t) for t, n in tier.items())
    counts, encoded = tokencount.Counts(path, tier), []
    model = counts.lengths._model

    class Spy:
        def tokenize(self, text):
            encoded.append(text)
            return model.tokenize(text)

    counts.lengths._model = Spy()
    text = "the the the cat 🙂 " + "long" * 40
    for _ in range(3):
        assert counts(text) == library_count(path, text)
    assert encoded.count("long" * 40) == 0 and sum("long" in x for x in encoded) == 3  # too long to be kept
    assert not any(x in ("the", "Ġthe") for x in encoded)
    assert len(encoded) == len(set(encoded)) + 2  # all else is encoded once


def test_a_full_cache_starts_anew(monkeypatch):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 5)
    counts = tokencount.Counts(path, {" the": 1})
    for i in range(30):
        text = f" the word{i} the 🙂{i} number {i * i}"
        assert counts(text) == library_count(path, text)
        assert len(counts.lengths) <= 6 and counts.lengths[" the"] == 1
