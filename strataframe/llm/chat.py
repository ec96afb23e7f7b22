"""Quotation linking: conversations in reply order, without quotes.

Each message is split into its own lines and quoted passages by level (``>``, ``> >``, ``>>`` and so on). A passage, and
each of its lines, is normalised (ASCII case folded, white space collapsed) and hashed; the hashes meet those of own texts,
paragraphs and lines of earlier messages of the conversation in an equality join. The quotes of each level link to the
message that they match: by the whole passage first, then by most lines, then the latest. A message replies to the link of
its shallowest level that has one. A message without a link replies to the one before it.

Messages that follow each other without a link elsewhere form a branch; a link to a message that is not the one before
begins a new branch. Reply order goes through a branch to its end, then through the branches that start from it, each with
its own, in order of their start.

Messages are sorted once by conversation and turn over ranges of bounded size; what a message needs of those before it is
looked up inside its range and carried on from range to range, and branches are put in order by doubling. So a conversation
of any length, the rows without a conversation among them, takes a few joins and none is gathered in one place.

Lines of attribution (ending in ``wrote:``, ``schrieb:``, ``a écrit :`` or ``escribió:``) right before a quote go with it.

Defined results: a null or empty text has no quotes and an empty clean text stays as it is (null stays null); a message of
quotes alone has an empty clean text; messages of the same turn are ordered by role and a hash of the text, and a link names the turn;
a null turn comes first in its conversation; a null conversation is one of its own; repeated rows stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import written
from .tokens import bounded_batches

#: Bits of a number from ``monotonically_increasing_id`` that count rows inside a partition.
RANK_BITS = 33
_PREFIX = re.compile(r"[\x20\t]?(?:>[\x20\t]?)+")
_SPACE = re.compile(r"[\x20\t-\r]+")
_ATTRIBUTION = re.compile(r"(?i)(?:wrote|schrieb|a écrit|escribió)[\x20\xa0]?:\s*$")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Passage(NamedTuple):
    level: int
    lines: tuple[str, ...]


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ").translate(_FOLD)


def parse(text: str) -> tuple[str, list[Passage]]:
    """The text without quotes, and its passages: runs of quoted lines of one level."""
    own: list[str] = []
    passages: list[Passage] = []
    run: list[str] = []
    level = 0

    def close() -> None:
        nonlocal run
        if any(normal(x) for x in run):
            passages.append(Passage(level, tuple(run)))
        run = []

    for line in text.split("\n"):
        mark = _PREFIX.match(line)
        depth = mark[0].count(">") if mark else 0
        if depth != level:
            if level:
                close()
            elif own and _ATTRIBUTION.search(own[-1]):
                own.pop()
            level = depth
        if depth:
            run.append(line[mark.end() :])
        else:
            own.append(line)
    if level:
        close()
    if not passages and len(own) == text.count("\n") + 1:
        return text, []
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), passages


def units(text: str) -> set[str]:
    """What a quote of this text may be: the whole, a paragraph, a line; normalised, not empty."""
    return {u for part in (text, *re.split(r"\n[\x20\t\r]*\n", text), *text.split("\n")) if (u := normal(part))}


def _parsed(messages: DataFrame) -> DataFrame:
    """Rows with clean text, own units and quoted units (whole passage: weight of all its lines; line: 1)."""
    quote = pa.list_(pa.struct([("unit", pa.string()), ("weight", pa.int32()), ("whole", pa.bool_()), ("level", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, counts, own, quoted = [], [], [], []
            for text in batch.column(4).to_pylist():
                plain, passages = parse(text or "")
                clean.append(None if text is None else plain)
                counts.append(len(passages))
                own.append(sorted(units(plain)))
                found = {}
                for p in passages:
                    lines = [normal(x) for x in p.lines if normal(x)]
                    found.update({(x, False, p.level): 1 for x in lines})
                    found[normal(" ".join(p.lines)), True, p.level] = len(lines)
                quoted.append([{"unit": u, "weight": w, "whole": whole, "level": level} for (u, whole, level), w in sorted(found.items())])
            columns = [pa.array(clean, pa.string()), pa.array(counts, pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array(quoted, quote)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), *columns], names=["row", "conv_id", "turn", "role", "clean", "n_quotes", "own", "quoted"])

    kinds = [messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")]
    return messages.mapInArrow(run, "row long, conv_id {}, turn {}, role {}, clean string, n_quotes long, own array<string>, quoted array<struct<unit: string, weight: int, whole: boolean, level: int>>".format(*kinds))


def part_of(row: Column) -> Column:
    """The range of the order that a row lies in: the leading bits of a number from ``monotonically_increasing_id``."""
    return F.shiftright(row, RANK_BITS)


def carried(rows: DataFrame, value: Column, schema: StructType) -> DataFrame:
    """part, before (rows in earlier parts), carry: the greatest ``value`` of all earlier parts. There is one row for each
    part, that is at most as many as the shuffle has partitions, so they may meet in the driver and be broadcast."""
    parts = rows.groupBy(part_of(F.col("row")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("value")).orderBy("part").collect()
    out, before, last = [], 0, None
    for r in parts:
        out.append((r.part, before, last))
        before, last = before + r.n, last if r.value is None else r.value
    return F.broadcast(rows.sparkSession.createDataFrame(out, schema))


def latest_units(asked: DataFrame, offered: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``asked`` (key, conv_id, unit, row, ...) with the latest earlier row of ``offered`` (key, conv_id, unit, row, turn)
    that has the same unit, as ``of`` and ``of_turn``.

    Units meet on their hash and are compared as such. Within a part of the order a window looks for the latest row; what is
    not found there is taken from the last row of each earlier part, one row a part. So neither a unit that half of a
    conversation's messages hold nor a conversation of any length makes a large group.
    """
    same = ["key", "conv_id", "unit"]
    wanted = written(asked.select("key").distinct(), "quoted-keys")
    offered = offered.join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, "key", "left_semi").withColumn("part", part_of(F.col("row")))
    both = offered.withColumn("asked", F.lit(None).cast(asked.select(F.struct("weight", "whole", "level")).schema[0].dataType)).unionByName(
        asked.select(*same, "row", F.lit(None).cast(offered.schema["turn"].dataType).alias("turn"), part_of(F.col("row")).alias("part"), F.struct("weight", "whole", "level").alias("asked"))
    )
    before = Window.partitionBy(*same, "part").orderBy("row", F.col("asked").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("source", F.last(F.when(F.col("asked").isNull(), F.struct("row", "turn")), ignorenulls=True).over(before)).filter(F.col("asked").isNotNull())
    ends = both.groupBy(*same, "part").agg(F.max(F.when(F.col("asked").isNull(), F.struct("row", "turn"))).alias("end"))
    earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carry", F.last("end", ignorenulls=True).over(earlier)).filter(F.col("carry").isNotNull())
    ends = ends.select(F.col("key").alias("end_key"), F.col("conv_id").alias("end_conv"), F.col("unit").alias("end_unit"), F.col("part").alias("end_part"), "carry")
    match = (F.col("key") == F.col("end_key")) & (F.col("part") == F.col("end_part")) & (F.col("unit") == F.col("end_unit")) & F.col("conv_id").eqNullSafe(F.col("end_conv"))
    found = here.join(ends, match, "left").withColumn("source", F.coalesce("source", "carry")).filter(F.col("source").isNotNull())
    return found.select("row", "asked.*", F.col("source.row").alias("of"), F.col("source.turn").alias("of_turn"))


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, clean, n_quotes, reply_to (turn; null: none), linked (by a quote), branch_depth, reply_order
    (from 1 in each conversation), links (level and turn of each level that has a link, shallowest first)."""
    bounded_batches(messages.sparkSession)
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # all messages in one order, in ranges of bounded size: rows that are equal throughout are told apart by a number
    order = ["conv_id", "turn", "role", "text_hash", "tie"]
    placed = base.withColumns({"text_hash": F.xxhash64("text"), "tie": F.rand(7)}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(_parsed(placed.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "text")), "messages")

    def key(unit: str) -> Column:
        return F.xxhash64(F.col("conv_id").cast("string"), F.col("conv_id").isNull(), unit)

    asked = rows.filter(F.size("quoted") > 0).select("row", "conv_id", F.explode("quoted").alias("q")).select("row", "conv_id", "q.*").withColumn("key", key("unit"))
    offered = rows.select("row", "conv_id", "turn", F.explode("own").alias("unit")).withColumn("key", key("unit"))
    hits = latest_units(asked, offered)
    scores = hits.groupBy("row", "level", "of").agg(F.max("whole").alias("whole"), F.sum(F.when(~F.col("whole"), F.col("weight"))).alias("lines"), F.max("of_turn").alias("of_turn"))
    by_level = scores.groupBy("row", "level").agg(F.max(F.struct("whole", "lines", "of", "of_turn")).alias("best"))
    links = by_level.groupBy("row").agg(F.min(F.struct("level", "best.of", "best.of_turn")).alias("first"), F.sort_array(F.collect_list(F.struct("level", F.col("best.of_turn").alias("turn")))).alias("links"))
    links = written(links.select("row", F.col("first.of").alias("to"), F.col("first.of_turn").alias("to_turn"), "links"), "quote-links")

    # the message before each, and where branches begin
    slim = rows.select("row", "conv_id", "turn", part_of(F.col("row")).alias("part"))
    message = F.struct("row", "conv_id", "turn")
    kind = slim.select(message).schema[0].dataType
    ends = carried(slim, message, StructType([StructField("part", LongType()), StructField("before", LongType()), StructField("carry", kind)]))
    in_part = Window.partitionBy("part").orderBy("row")
    linked = slim.join(links, "row", "left").join(ends, "part").withColumn("previous", F.coalesce(F.lag(message).over(in_part), "carry"))
    first = F.col("previous").isNull() | ~F.col("previous.conv_id").eqNullSafe(F.col("conv_id"))
    begins = linked.withColumns({"first": first, "jump": ~first & F.col("to").isNotNull() & (F.col("to") < F.col("previous.row"))})
    begin = F.max(F.when(F.col("first") | F.col("jump"), F.col("row"))).over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    marked = written(begins.select("row", "part", "before", "to", F.when(F.col("to").isNotNull(), F.col("to_turn")).when(~F.col("first"), F.col("previous.turn")).alias("reply_to"), "links", "jump", begin.alias("begin")), "marked")
    starts = carried(marked, F.col("begin"), StructType([StructField("part", LongType()), StructField("rows_before", LongType()), StructField("carry", LongType())]))
    branched = marked.join(starts, "part").withColumn("branch", F.coalesce("begin", "carry")).drop("rows_before", "carry", "begin")
    ranks = branch_ranks(branched)
    local = (1 << RANK_BITS) - 1
    dense = F.col("before") + F.col("row").bitwiseAND(F.lit(local))
    of_branch = F.col("branch_before") + F.col("branch").bitwiseAND(F.lit(local))
    offsets = F.broadcast(ends.select(F.col("part").alias("branch_part"), F.col("before").alias("branch_before")))
    done = branched.join(offsets, part_of(F.col("branch")) == F.col("branch_part")).withColumn("nth", dense - of_branch)
    if ranks is not None:
        # a branch's rows are taken part by part, so that a long one does not meet in one task
        by_part = done.select("branch", "part").distinct().join(ranks, "branch")
        done = done.join(by_part, ["branch", "part"], "left")
    else:
        done = done.withColumns({"offset": F.lit(0), "depth": F.lit(0)})
    result = done.select("row", "reply_to", F.col("to").isNotNull().alias("linked"), F.coalesce("depth", F.lit(0)).cast("long").alias("branch_depth"), (F.col("nth") + F.coalesce("offset", F.lit(0)) + 1).cast("long").alias("reply_order"), "links")
    joined = rows.drop("own", "quoted").join(result, "row")
    return joined.select("conv_id", "turn", "role", "clean", "n_quotes", "reply_to", "linked", "branch_depth", "reply_order", F.coalesce("links", F.array().cast(marked.schema["links"].dataType)).alias("links"))


def branch_ranks(branched: DataFrame, max_rounds: int = 64) -> DataFrame | None:
    """branch, offset (messages before it in reply order), depth; of conversations that have more than one branch.

    A walk through the tree of branches enters and leaves each branch once; every step knows the one before it (the leaving
    of the sibling before, the entering of the parent, the leaving of the last child). Sums along the walk give offsets and
    depths; they are taken by doubling, in as many joins as the walk's length has binary digits, each of which holds two rows
    a branch. None if no conversation has a second branch.
    """
    jumps = branched.filter("jump").select(F.col("row").alias("branch"), "to")
    if jumps.isEmpty():
        return None
    parents = branched.join(jumps.select(F.col("to").alias("row")).distinct(), "row").select(F.col("row").alias("to"), F.col("branch").alias("parent"))
    children = written(jumps.join(parents, "to").select("branch", "parent").repartitionByRange("parent", "branch").sortWithinPartitions("parent", "branch").withColumn("row", F.monotonically_increasing_id()), "branches")
    here = F.struct("row", "parent", "branch")
    kind = children.select(here).schema[0].dataType
    ends = carried(children, here, StructType([StructField("part", LongType()), StructField("before", LongType()), StructField("carry", kind)]))
    near = children.withColumn("part", part_of(F.col("row"))).join(ends, "part").withColumn("previous", F.coalesce(F.lag(here).over(Window.partitionBy("part").orderBy("row")), "carry"))
    sibling = F.when(F.col("previous.parent") == F.col("parent"), F.col("previous.branch"))
    nodes = near.select("branch", "parent", sibling.alias("sibling"))
    roots = children.select(F.col("parent").alias("branch")).distinct().join(children, "branch", "left_anti").select("branch", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("sibling"))
    last = children.groupBy(F.col("parent").alias("branch")).agg(F.max("branch").alias("last"))
    sizes = branched.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    nodes = nodes.union(roots).join(last, "branch", "left").join(sizes, "branch")
    enter, leave = (lambda c: c * 2), (lambda c: c * 2 + 1)
    walk = nodes.select(enter(F.col("branch")).alias("step"), F.coalesce(leave(F.col("sibling")), enter(F.col("parent"))).alias("back"), F.col("n").alias("rows"), F.lit(1).cast("long").alias("level")).union(
        nodes.select(leave(F.col("branch")), F.coalesce(leave(F.col("last")), enter(F.col("branch"))), F.lit(0).cast("long"), F.lit(-1).cast("long"))
    )
    walk = written(walk, "walk")
    for _ in range(max_rounds):
        open_ = walk.filter(F.col("back").isNotNull())
        if open_.isEmpty():
            break
        before = walk.select(F.col("step").alias("back"), F.col("back").alias("further"), F.col("rows").alias("more"), F.col("level").alias("levels"))
        moved = open_.join(before, "back").select("step", F.col("further").alias("back"), (F.col("rows") + F.col("more")).alias("rows"), (F.col("level") + F.col("levels")).alias("level"))
        walk = written(walk.filter(F.col("back").isNull()).union(moved), "walk")
    else:
        raise RuntimeError("the walk through the branches does not end")
    return walk.filter(F.col("step") % 2 == 0).select(F.shiftright("step", 1).alias("branch"), "rows", (F.col("level") - 1).alias("depth")).join(sizes, "branch").select("branch", (F.col("rows") - F.col("n")).alias("offset"), "depth")
