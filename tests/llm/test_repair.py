"""Repair of conversations against a plain search over all states, with small blocks, long conversations and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strataframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, block string, n int, conv string"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, "clash") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text, *key in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, must go, truncated). Cost, audit and repaired rows, by the best of each state after each row."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, done) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := STEPS.get((state, role[0]))) is not None:
                        new = cost + 2, audit + "I", done + ((role, ""),)
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = {0: (0, "", ())}
    for role, text, gone, truncated in rows:
        best, after = inserted(best), {}
        for state, (cost, audit, done) in best.items():
            options = [(state, cost + 3, audit + "D", done)]
            for new in (role, "user", "assistant"):
                if not gone and (to := STEPS.get((state, new[:1]))) is not None:
                    kept = new is role
                    options.append((to, cost + 2 * (not kept) + truncated, audit + "RK"[kept], (*done, (new, text))))
            for to, *option in options:
                if to not in after or tuple(option[:2]) < after[to][:2]:
                    after[to] = tuple(option)
        best = after
    return min((x for s, x in inserted(best).items() if s in (0, 3)), key=lambda x: x[:2])


def brute(rows, damaged=True):
    order = sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r[1:]))
    convs = collections.defaultdict(list)
    for r in damage(order) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in order]:
        convs[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        seen, marked, n, here = set(), [], collections.Counter(), convs[conv]
        for _, role, text in here:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            duplicate = not blank and (role, text) in seen
            truncated = not blank and not duplicate and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            seen.add((role, text))
            n.update(blank=blank, duplicate=duplicate, truncated=truncated)
            marked.append((role, text, blank or duplicate, truncated))
        turns = [t for t, *_ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:], strict=False))
        cost, audit, done = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in done)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "  ", "So it is. ", "open end,", "fine!\n", "", None]
    rows = []
    for c in range(n):
        turn = 0
        for k in range(rng.randint(1, length)):
            turn += rng.choice([1, 1, 1, 1, 2, 0])
            role = rng.choice(["system", "tool", None, "", "assistant", "user", "admin"]) if rng.random() < 0.15 else ("user", "assistant")[k % 2]
            rows.append((c, rng.choice([turn] * 9 + [None]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_repair_equals_a_plain_search(spark, bits):
    rows = conversations(bits, 120, 12) + conversations(9, 1, 200)[:]
    found = repair.repaired_conversations(frame(spark, rows), damage=True, block_bits=bits)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    if bits == 3:
        found = repair.repaired_conversations(frame(spark, rows), block_bits=bits)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, damaged=False)


def test_a_hot_conversation_and_a_hot_row(spark):
    rows = [(7, t, ("user", "assistant")[t % 3 > 0], f"line {t % 700}.") for t in range(3000)] + [(8, 1, "user", "again.")] * 2000 + conversations(4, 10, 5)
    found = repair.repaired_conversations(frame(spark, rows), block_bits=8)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, damaged=False)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (5, None, "user", "a."), (5, None, "user", "a."), (6, 0, None, "b."), (6, 3, "", "c."), (9, 1, "user", "y" * 300_000), (9, 2, "assistant", "日本。"), (10, -3, "🙂", "z!")]
    for damaged in (True, False):
        found = repair.repaired_conversations(frame(spark, rows), damage=damaged)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, damaged)
    assert repair.repaired_conversations(frame(spark, []), damage=True).count() == 0


def test_grammar_gives_back_its_sequences():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 9, 12) for _ in range(6)]
    sequences = [np.concatenate([words[k] for k in rng.integers(0, 6, rng.integers(1, 9))]) for _ in range(200)] + [np.zeros(0, np.int64), np.full(501, 2)]
    compressed, rules = repair.re_pair(sequences)

    def whole(symbol):
        return [symbol] if symbol < repair.SYMBOLS else [x for side in rules[symbol - repair.SYMBOLS] for x in whole(side)]

    assert [[x for s in c for x in whole(s)] for c in compressed] == [s.tolist() for s in sequences]
    assert len(rules) > 20 and sum(map(len, compressed)) < sum(map(len, sequences)) / 3
    assert repair.re_pair([]) == ([], [])
