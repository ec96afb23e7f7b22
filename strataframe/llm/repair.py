"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A row is a symbol: the initial of its role and its first fault. What may happen to a row, insertions before it included, is a
min-plus matrix over the states of the grammar ``(s?(ua)+)?``; an entry has its cost and its audit, the initials of the edits
(Delete, Insert, Keep, Rerole), of which the ASCII-least wins among equal costs. Two audits of one entry and cost are never
one the other's beginning (they take the same rows and differ in insertions, which cost), so the least of a whole is made of
the least of its parts, and products may be taken in any order. The symbol sequences of many conversations are compressed by
Re-Pair; each rule of the grammar gets one matrix, the product of its two sides with ropes for audits, evaluated bottom-up
once and shared by all conversations in which the rule occurs.

Rows are placed in one global order by range, so no conversation has to fit in a task; a conversation is cut into blocks of
rows, a matrix each, and the blocks' matrices are multiplied in order. Edits then go back to the rows of their block. Equal rows of
a conversation are one row with a count. Only the hash of a repaired text takes its lines one after another, as a stream.

Defined results: null roles, texts and turns read as one space, so a null text is blank and a null role has to be changed;
rows without a conversation's number are one conversation; turns go by number, nulls first, ties by role, then text; a
conversation without rows has no faults, no edits and an empty text; an empty table gives an empty result; extra columns are
ignored. A conversation's audit is one string, so it has fewer than 2^31 edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import bounded_batches

#: States of the grammar: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Costs of edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Symbols: initials s, u, a or another (0 to 3), the same truncated (4 to 7), rows that have to go.
INITIALS, GONE, SYMBOLS = "sua", 8, 9
LEGAL = ("su", "ua", "au")
#: Rows of a block: 2 to this power. A rule of the grammar occurs so often at least in its batch, and there are so many at most.
BLOCK_BITS, LEAST_USES, MOST_RULES = 16, 8, 512
#: Letters that an audit's rope joins to one string.
JOINED = 64

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def letters(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        rope = todo.pop()
        if isinstance(rope, str):
            out.append(rope)
        else:
            todo += (rope[1], rope[0])
    return "".join(out)


def _joined(a: Rope, b: Rope) -> Rope:
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= JOINED else (a, b) if a and b else a or b


def product(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product; of equal costs the ASCII-least audit."""
    out: Matrix = {}
    for (i, k), (cost, audit) in x.items():
        for (m, j), (more, rest) in y.items():
            if m != k:
                continue
            best = out.get((i, j))
            if best is None or cost + more < best[0]:
                out[i, j] = cost + more, _joined(audit, rest)
            elif cost + more == best[0] and letters(both := _joined(audit, rest)) < letters(best[1]):
                out[i, j] = cost + more, both
    return out


#: Insertions between rows: a user where one may come, an assistant after a user.
INSERTED: Matrix = {(s, s): (0, "") for s in range(4)}
INSERTED |= {(s, USER): (INSERT, "I") for s in (START, SYSTEM, ASSISTANT)} | {(USER, ASSISTANT): (INSERT, "I")}
INSERTED |= {(s, ASSISTANT): (2 * INSERT, "II") for s in (START, SYSTEM)}


def row_matrix(symbol: int) -> Matrix:
    edits: Matrix = {(s, s): (DELETE, "D") for s in range(4)}
    if symbol != GONE:
        initial, more = symbol % 4, TRUNCATED * (symbol >= 4)
        steps = {(START, SYSTEM): 0, (START, USER): 1, (SYSTEM, USER): 1, (ASSISTANT, USER): 1, (USER, ASSISTANT): 2}
        for step, role in steps.items():
            if role == initial:
                edits[step] = more, "K"
            elif role:
                edits[step] = REROLE + more, "R"
    return product(INSERTED, edits)


def re_pair(sequences: list[np.ndarray]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The sequences with pairs replaced by rules, most frequent pair first, and the two symbols of each rule (the first
    rule's symbol is SYMBOLS)."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    text = np.full(lengths.sum() + len(sequences), -1, np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    if lengths.sum():
        text[np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.concatenate(sequences)
    rules: list[tuple[int, int]] = []
    while len(rules) < MOST_RULES:
        kinds = SYMBOLS + len(rules)
        pair = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * kinds + text[1:], kinds * kinds)
        uses = np.bincount(pair, minlength=kinds * kinds + 1)[:-1]
        best = int(uses.argmax())
        if uses[best] < LEAST_USES:
            break
        at = np.flatnonzero(pair == best)
        if best // kinds == best % kinds:  # in a run of one symbol every other place
            run = np.concatenate([[True], np.diff(at) > 1])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
        text[at] = kinds
        text = np.delete(text, at + 1)
        rules.append((best // kinds, best % kinds))
    cuts = np.flatnonzero(text < 0)
    return [text[a:b].tolist() for a, b in zip(np.concatenate([[0], cuts[:-1] + 1]), cuts, strict=True)] if len(cuts) else [], rules


def matrices(sequences: list[np.ndarray]) -> list[Matrix]:
    """One for each sequence, by the grammar of all of them."""
    compressed, rules = re_pair(sequences)
    known = [row_matrix(s) for s in range(SYMBOLS)]
    for a, b in rules:  # a rule's sides come before it
        known.append(product(known[a], known[b]))
    out = []
    for symbols in compressed:
        level = [known[s] for s in symbols] or [{(s, s): (0, "") for s in range(4)}]
        while len(level) > 1:
            level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        out.append(level[0])
    return out


def name(conv: Column) -> Column:
    """A conversation's key: not null, and different for no number and any number."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def counted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, first_role, first_text, role, text, n: each different row once. Roles and texts may be changed; the first ones
    keep the order."""
    columns = [F.col(c).alias(name) for c, name in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "first_role"), (text_col, "first_text"))]
    rows = conversations.select(columns).groupBy("conv_id", "turn", "first_role", "first_text").agg(F.count(F.lit(1)).alias("n"))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("first_role", "first_text"))
    return rows.select(name(F.col("conv_id")).alias("conv"), F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("number"), "turn", "first_role", "first_text", role.alias("role"), text.alias("text"), "n")


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows of ``counted`` with faults planted by a hash of conversation and turn: rows dropped, emptied, without ends of
    sentences, repeated, or given to the user."""
    kind = F.crc32(F.concat("number", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % kinds
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = {"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role")), "n": F.col("n") * F.when(kind == 3, 2).otherwise(1)}
    return rows.filter(kind != 0).withColumns(changed)


def placed(rows: DataFrame, block_bits: int) -> DataFrame:
    """Rows in one global order: at, block (rows of one task and at most 2^block_bits of them), and what is wrong with each."""
    order = ["conv", F.asc_nulls_first("turn"), F.asc_nulls_first("first_role"), F.asc_nulls_first("first_text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1)
    return spread.select(
        "conv", "turn", "role", "text", "n", at.alias("at"), F.shiftright(at, block_bits).alias("block"), initial.cast("int").alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), F.md5("text").alias("digest"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The placed rows without texts, with new: whether role and text are not seen earlier in the conversation."""
    new = rows.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    return rows.select("conv", "turn", "n", "at", "block", "initial", F.substring("role", 1, 1).alias("letter"), "blank", "truncated").join(new, "at", "left").withColumn("new", F.coalesce("new", F.lit(False)))


def counts(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated."""
    once = F.col("new").cast("long")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - once)).alias("duplicate"),
        F.sum(F.when(F.col("truncated") & ~F.col("blank"), once).otherwise(0)).alias("truncated"),
    )


MATRIX = "array<struct<a:int,b:int,cost:long,audit:string>>"


def transfers(rows: DataFrame) -> DataFrame:
    """conv, block, head, tail (initials of its first and last row), illegal (within it), matrix."""
    symbol = F.when(F.col("new"), F.col("initial") + F.when(F.col("truncated"), 4).otherwise(0)).otherwise(GONE)
    lists = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("at", symbol.alias("symbol"), "letter", "n"))).alias("rows"))
    lists = lists.select("conv", "block", "rows.symbol", "rows.letter", "rows.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, heads, tails, illegal = [], [], [], []
            for symbols, roles, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                # of equal rows all but the first have to go
                copies = np.array(n)
                sequence = np.repeat(np.array(symbols), copies)
                sequence[np.arange(len(sequence)) != np.repeat(np.cumsum(copies) - copies, copies)] = GONE
                sequences.append(sequence)
                heads.append(roles[0])
                tails.append(roles[-1])
                illegal.append(sum(a + b not in LEGAL for a, b in pairwise(roles)) + int((copies - 1).sum()))
            found = [[{"a": a, "b": b, "cost": cost, "audit": letters(audit)} for (a, b), (cost, audit) in m.items()] for m in matrices(sequences)]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.string()), pa.array(tails, pa.string()), pa.array(illegal, pa.int64()), pa.array(found, kind)], names=["conv", "block", "head", "tail", "illegal", "matrix"])

    return lists.mapInArrow(run, f"conv string, block long, head string, tail string, illegal long, matrix {MATRIX}")


def plans(blocks: DataFrame) -> DataFrame:
    """conv, illegal, cost, audit, pieces (block, state before it, audit) of the cheapest edits."""
    lists = blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "head", "tail", "illegal", "matrix"))).alias("blocks"))

    def plan(parts: list[dict]) -> tuple[int, str, list[dict]]:
        reached: dict[int, tuple[int, Rope, tuple | None]] = {START: (0, "", None)}
        for part in parts:
            ahead: dict[int, tuple[int, Rope, tuple | None]] = {}
            for entry in part["matrix"]:
                if entry["a"] in reached:
                    cost, rope, steps = reached[entry["a"]]
                    cost, rope = cost + entry["cost"], _joined(rope, entry["audit"])
                    best = ahead.get(entry["b"])
                    if best is None or cost < best[0] or cost == best[0] and letters(rope) < letters(best[1]):
                        ahead[entry["b"]] = cost, rope, (steps, part["block"], entry["a"], entry["audit"])
            reached = ahead
        done = [(cost + INSERTED[s, e][0], letters(rope) + INSERTED[s, e][1], INSERTED[s, e][1], steps) for s, (cost, rope, steps) in reached.items() for e in ENDS if (s, e) in INSERTED]
        cost, audit, last, steps = min(done, key=lambda x: x[:2])
        pieces = []
        while steps:
            steps, block, state, piece = steps
            pieces.append({"block": block, "state": state, "audit": piece + last})
            last = ""
        return cost, audit, pieces[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, found = [], []
            for parts in batch.column(1).to_pylist():
                illegal.append(sum(p["illegal"] for p in parts) + sum(a["tail"] + b["head"] not in LEGAL for a, b in pairwise(parts)))
                found.append(plan(parts))
            kind = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string())]))
            columns = [batch.column(0), pa.array(illegal, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "illegal", "cost", "audit", "pieces"])

    return lists.mapInArrow(run, "conv string, illegal long, cost long, audit string, pieces array<struct<block:long,state:int,audit:string>>")


class Editor:
    """Applies a block's edits to its rows, in order."""

    def __init__(self, state: int, audit: str):
        self.state, self.audit, self.at = state, audit, 0

    def due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        """What comes in before the next row, or after the last."""
        while self.audit.startswith("I", self.at):
            role = self.due()
            self.at, self.state = self.at + 1, ASSISTANT if role == "assistant" else USER
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            role = self.due() if edit == "R" else role
            self.state = 1 + INITIALS.index(role[0])
            yield role, text


def lines(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv, block, nth, role, text: the rows of repaired conversations. Each task reads a block's edits, then its rows."""
    pieces = planned.select("conv", F.explode("pieces").alias("p")).select("conv", F.col("p.block").alias("block"), F.lit(-1).cast("long").alias("at"), F.col("p.state").alias("state"), F.lit("").alias("role"), F.col("p.audit").alias("text"), F.lit(0).cast("long").alias("n"))
    both = pieces.union(rows.select("conv", "block", "at", F.lit(0).alias("state"), "role", "text", "n"))
    sorted_rows = both.repartition("conv", "block").sortWithinPartitions("conv", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, block, nth = None, None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(found: Iterator[tuple[str, str]], out: list[tuple] = out) -> None:
                nonlocal nth
                for role, text in found:
                    out.append((conv, block, nth, role, text))
                    nth += 1

            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, state, role, text, n = row[2:]
                if at < 0:
                    if editor:
                        put(editor.inserted())
                    editor, conv, block, nth = Editor(state, text), row[0], row[1], 0
                else:
                    for _ in range(n):
                        put(editor.row(role, text))
            yield _batch(out)
        if editor:
            yield _batch([(conv, block, nth + k, *line) for k, line in enumerate(editor.inserted())])

    return sorted_rows.mapInArrow(run, "conv string, block long, nth long, role string, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv", "block", "nth", "role", "text"])


def hashes(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of lines: ``role:text``, joined by newlines, line after line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["conv", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "block", "nth").select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Of rows as ``counted`` gives them: a summary of each conversation (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit) and the repaired lines (conv, block, nth, role, text)."""
    bounded_batches(rows.sparkSession)
    rows = written(placed(rows, block_bits), "placed")
    faulty = written(faults(rows), "faults")
    planned = written(plans(written(transfers(faulty), "transfers")), "plans")
    return counts(faulty).join(planned.drop("pieces"), "conv"), lines(rows, planned)


def repaired_conversations(conversations: DataFrame, damage: bool = False, block_bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = counted(conversations)
    summary, repaired = repair(damaged(rows) if damage else rows, block_bits)
    every = conversations.select("conv_id").distinct().withColumn("conv", name(F.col("conv_id")))
    joined = every.join(summary, "conv", "left").join(hashes(repaired), "conv", "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
