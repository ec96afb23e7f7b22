"""Quotation linking against a plain single-process version, URL rules and reputation, and odd rows."""

import random

from strataframe.llm import chat, urls

SCHEMA = "conv_id long, turn long, role string, text string, row int, of string, nth string, path int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def links(spark, rows):
    return {(r.conv_id, r.turn): r for r in chat.link_quotes(messages(spark, rows)).collect()}


def test_levels_and_attribution():
    clean, passages = chat.parse("Yes.\n\nOn Monday Ann wrote:\n> Shall we\n> meet?\n> > Earlier\n>> text\n> And again\nBye.")
    assert clean == "Yes.\n\nBye."
    assert [(p.level, p.lines) for p in passages] == [(1, ("Shall we", "meet?")), (2, ("Earlier", "text")), (1, ("And again",))]
    assert chat.parse("a > b\nx") == ("a > b\nx", [])
    assert chat.parse("> only") == ("", [chat.Passage(1, ("only",))])
    assert chat.parse("")[1] == [] and chat.parse(">\n>>\n> ")[1] == []


def test_branches_in_reply_order(spark):
    rows = [
        (1, 0, "user", "First question\nwith two lines"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "More on that"),
        (1, 3, "user", "> first   QUESTION\n> with two lines\nBack to this"),
        (1, 4, "assistant", "> An answer\nAnother branch"),
        (1, 5, "user", "> Back to this\nNested"),
        (1, 6, "user", "goes on"),
        (2, 0, "user", "> First question\nnot in this conversation"),
        (2, 1, "user", "An answer"),
    ]
    got = links(spark, rows)
    assert [(t, got[1, t].reply_to, got[1, t].linked) for t in range(7)] == [(0, None, False), (1, 0, False), (2, 1, False), (3, 0, True), (4, 1, True), (5, 3, True), (6, 5, False)]
    assert sorted(range(7), key=lambda t: got[1, t].reply_order) == [0, 1, 2, 3, 5, 6, 4]
    assert [got[1, t].branch_depth for t in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    assert got[1, 3].clean == "Back to this" and not got[2, 0].linked and got[2, 1].reply_to == 0


def test_links_match_a_plain_search(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(12):
        texts = []
        for t in range(rng.randint(1, 12)):
            own = "\n".join(rng.choice(["yes", "no", f"line {c} {t}", f"text {rng.randint(0, 5)}"]) for _ in range(rng.randint(1, 3)))
            quote, source = "", None
            if texts and rng.random() < 0.6:
                source = rng.randrange(len(texts))
                quote = "\n".join("> " + x for x in texts[source].split("\n")) + "\n"
            whole = chat.normal(texts[source]) if source is not None else None
            if whole is not None:
                lines = {chat.normal(x) for x in texts[source].split("\n")}
                latest = {u: max((k for k, x in enumerate(texts) if u in chat.units(x)), default=None) for u in {*lines, whole}}
                score = {}
                for u in lines:
                    if latest[u] is not None:
                        score.setdefault(latest[u], [False, 0])[1] += 1
                if latest[whole] is not None:
                    score.setdefault(latest[whole], [False, 0])[0] = True
                want[c, t] = max(score, key=lambda k: (*score[k], k))
            rows.append((c, t, "user", quote + own))
            texts.append(own)
    got = links(spark, rows)
    assert {k: r.reply_to for k, r in got.items() if r.linked} == want
    for c in range(12):
        assert sorted(r.reply_order for (k, _), r in got.items() if k == c) == list(range(1, 1 + sum(k == c for k, _ in got)))


def test_odd_messages(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "> a\nb"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 2, "user", "> " * 2000 + "deep"), (1, 3, "user", "word " * 50_000)]
    got = chat.link_quotes(messages(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.reply_to for r in got if r.conv_id is None and r.linked] == [0]
    assert chat.link_quotes(messages(spark, [])).count() == 0


def test_conversation_without_bound(spark):
    """A chain of links, each to the message before the last, nests as deep as there are messages."""
    rows = [(7, t, "user", (f"> text {t - 2}\n" if t > 1 else "") + f"text {t}") for t in range(40)]
    got = links(spark, rows)
    assert all(got[7, t].reply_to == t - 2 for t in range(2, 40))
    assert max(r.branch_depth for r in got.values()) == 19


def judged(spark, pages, labels=()):
    p = spark.createDataFrame([(*x, "h", 1) for x in pages], "page_id long, url string, host string, rate int")
    return {r.page_id: r for r in urls.judge(p, spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")).collect()}


def test_rules(spark):
    pages = [
        (1, "http://A.Example.COM/en/825?page=2"), (2, "https://x.example.com/en/72#t"), (3, "http://n.net/de/1"), (4, "http://example.net/de/8"), (5, "http://b.example.net/de/85/x"),
        (6, "http://q.org/es/"), (7, "http://example.community/en/1"), (8, "no scheme"), (9, None), (10, "http://h?x=/en/"), (11, "a://b://c/en/"), (12, "://com/en/"), (13, "http://example.com#/en/7"), (14, ""),
    ]
    got = judged(spark, pages)
    assert [(i, r.host, r.path, r.rule, r.verdict) for i, r in sorted(got.items())] == [
        (1, "a.example.com", "/en/825", "com/en/", "block"), (2, "x.example.com", "/en/72", "example.com/en/7", "allow"), (3, "n.net", "/de/1", "net/de/", "allow"), (4, "example.net", "/de/8", "example.net/de/8", "block"),
        (5, "b.example.net", "/de/85/x", "example.net/de/8", "block"), (6, "q.org", "/es/", "org/es/", "block"), (7, "example.community", "/en/1", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (10, "h", "", None, "allow"), (11, "b:", "//c/en/", None, "allow"), (12, "com", "/en/", "com/en/", "block"), (13, "example.com", "", None, "allow"), (14, "", "", None, "allow"),
    ]


def test_reputation_blocks_surely_bad_hosts(spark):
    pages = [(i, f"http://h{i % 20}.site{i % 4}.com/") for i in range(400)] + [(1000 + i, "http://farm.bad.com/") for i in range(60)] + [(2000, "http://new.bad.com/")]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(400)] + [(1000 + i, 0, 0) for i in range(50)] + [(5, None, None)]
    got = judged(spark, pages, labels)
    assert {r.host for r in got.values() if r.verdict == "block"} == {"farm.bad.com", "new.bad.com"}  # the domain's prior reaches a host without labels
    assert got[1000].bad_rate > got[2000].bad_rate > got[0].bad_rate
    assert judged(spark, [], labels) == {}


def test_suffixes(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("x.example.com",), ("localhost",), ("",)], "host string").select(urls.domain_of(urls.F.col("host")), urls.suffix_of(urls.F.col("host"))).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", "")]
    hosts = spark.createDataFrame([("u:p@w.example.com:8080",), ("example.com.",), ("10.20.30.40:80",), ("10.99.30.40",), ("[2001:db8::1]:80",)], "host string").select(urls.name_of(urls.F.col("host")).alias("name"))
    got = hosts.select(urls.domain_of(urls.F.col("name")), urls.suffix_of(urls.F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("example.com", "com"), ("example.com", "com"), ("10.20.30.40", "[]"), ("10.99.30.40", "[]"), ("[2001:db8::1]", "[]")]
