"""Quotes of every level are linked."""

import random

from strataframe.llm import chat

from .test_chat_and_urls import links


def test_deeper_levels_link_and_the_shallowest_decides(spark):
    rows = [
        (1, 0, "user", "First words"),
        (1, 1, "assistant", "Second words"),
        (1, 2, "user", "Third words"),
        (1, 3, "assistant", ">> First words\nOnly a deep quote"),
        (1, 4, "user", "> Second words\n> > First words\nBoth"),
        (1, 5, "user", "> not said here\n> > Third words\nDeeper alone is known"),
    ]
    got = links(spark, rows)
    assert [(got[1, t].reply_to, got[1, t].linked) for t in (3, 4, 5)] == [(0, True), (1, True), (2, True)]
    assert [[tuple(x) for x in got[1, t].links] for t in (2, 3, 4, 5)] == [[], [(2, 0)], [(1, 1), (2, 0)], [(2, 2)]]


def plain(rows):
    """reply_to, linked, depth, order and links of each message of one conversation, by a search through all earlier ones."""
    own, out, branch, parent = [], [], [], {}
    for t, text in enumerate(rows):
        clean, passages = chat.parse(text)
        by_level = {}
        for p in passages:
            asked = {(chat.normal(x), False) for x in p.lines if chat.normal(x)} | {(chat.normal(" ".join(p.lines)), True)}
            by_level.setdefault(p.level, set()).update(asked)
        links = {}
        for level, asked in by_level.items():
            scores = {}
            for unit, whole in asked:
                of = max((k for k, units in enumerate(own) if unit in units), default=None)
                if of is not None:
                    s = scores.setdefault(of, [False, -1])
                    if whole:
                        s[0] = True
                    else:
                        s[1] = max(s[1], 0) + 1
            if scores:
                links[level] = max(scores, key=lambda k: (*scores[k], k))
        to = links[min(links)] if links else None
        own.append(chat.units(clean))
        jump = to is not None and to < t - 1
        branch.append(t if jump or not t else branch[-1])
        if jump:
            parent[t] = branch[to]
        out.append([to if to is not None else t - 1 if t else None, to is not None, sorted(links.items())])
    order = []

    def walk(b):
        order.extend(t for t in range(len(rows)) if branch[t] == b)
        for c in sorted(c for c, p in parent.items() if p == b):
            walk(c)

    if rows:
        walk(0)
    depth = lambda b: 1 + depth(parent[b]) if b in parent else 0
    return [(*o, depth(branch[t]), order.index(t) + 1) for t, o in enumerate(out)]


def thread(rng, n, pool):
    texts = []
    for t in range(n):
        quote = ""
        if texts and rng.random() < 0.7:
            quoted = rng.choice(texts)
            keep = quoted.split("\n") if rng.random() < 0.7 else rng.sample(quoted.split("\n"), 1)
            mark = rng.choice(["> ", ">"])
            quote = "On Monday someone wrote:\n" * rng.randint(0, 1) + "\n".join(mark + x for x in keep) + "\n"
        texts.append(quote + "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"said {t} {rng.randint(0, 99)}" for _ in range(rng.randint(1, 3))))
    return texts


def test_threads_with_nested_quotes_match_a_plain_search(spark):
    """Small threads, one large one and one without an id, whose units many messages share, over more ranges than one."""
    rng = random.Random(12)
    pool = ["thanks", "see below", "Yes,  I agree", "text"]
    threads = {c: thread(rng, rng.randint(1, 9), pool) for c in range(25)} | {100: thread(rng, 400, pool), None: thread(rng, 60, pool)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, "user", x) for c, texts in threads.items() for t, x in enumerate(texts)]
        rng.shuffle(rows)
        got = links(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows)
    for c, texts in threads.items():
        want = plain(texts)
        for t in range(len(texts)):
            r = got[c, t]
            assert (r.reply_to, r.linked, [tuple(x) for x in r.links], r.branch_depth, r.reply_order) == want[t], (c, t)
