"""The trie of conversations against a plain one, over one and many partitions, with forests merged in several levels."""

import collections
import hashlib
import random
import zlib

import pytest

from strataframe.llm import trie

from .test_text_operators import WORD

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def brute(rows, heads=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own_members) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def key(row):
    return tuple(-1 if x is None else x for x in row)


def conversations(seed, n=150, long=3):
    rng = random.Random(seed)
    texts = ["", "a b", "one two three", "x", " \n", "hello there"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, long])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "system", None]) if rng.random() < 0.2 else "user", rng.choice(texts) if rng.random() < 0.8 else None))
        if c % 7 == 0:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed,parts,fan", [(1, 1, 4), (2, 7, 256), (3, 23, 2), (4, 60, 3)])
def test_trie_equals_a_plain_one(spark, seed, parts, fan):
    rows = conversations(seed, long=12)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for built, heads in ((trie.rebuilt, True), (trie.sequences, False)):
            found = trie.prefix_trie(built(frame(spark, rows)), fan=fan, broadcast_rows=0 if seed % 2 else 10**6)
            assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, heads), key=key)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"line {t}") for c in range(400) for t in range(3)] + [(1000, t, "user", f"line {t}") for t in range(900)] + [(1001, t, "user", f"line {t}") for t in range(500)]
    found = trie.prefix_trie(trie.sequences(frame(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, heads=False), key=key)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "x" * 200_000), (20, 0, "user", "a"), (23, 0, "u", "a"), (23, 1, "u", "b"), (7, 3, "", "")]
    found = trie.shared_prefixes(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows), key=key)
    assert found.columns == trie.NODE
    assert trie.shared_prefixes(frame(spark, [])).count() == 0
    only_empty = [(c, 0, "user", "a") for c in range(60) if zlib.crc32(str(c).encode()) % 4 and c % 20]
    assert [tuple(r) for r in trie.shared_prefixes(frame(spark, only_empty)).collect()] == brute(only_empty)


def test_ends_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 100)
    rows = spark.range(5000).selectExpr("cast(id % 3 as string) AS key", "id AS conv_id")
    assert {r.key: r.ends_sha256 for r in trie.ends(rows).collect()} == {str(k): hashlib.sha256(",".join(str(i) for i in range(k, 5000, 3)).encode()).hexdigest() for k in range(3)}
