"""Prefix trie of conversations: what they share from their first turn on, and how many tokens a shared prefix saves.

A conversation is a path of turn digests (MD5 of role and text). Equal paths are counted as one row. Paths are range-sorted;
within a partition neighbours' longest common prefixes are edges, merged by union-find in descending depth: each merge of
components makes the branching node at that depth, or meets one that ends or branches there already. A partition's forest
is then contracted to its spine, the nodes above its first and its last path, for only these may reach beyond it; the rest
is finished where it is. Spines of ``FAN`` neighbouring partitions at a time are merged by the same union-find over the
same kind of edges, level by level, until one task finishes the few that remain. Nodes between two branchings have one
child and the same members, so they are written out from the branching below them, with no state of their own.

The list of conversations that end at a node may be long: their numbers are sorted by range, joined to pieces of text, and
only the pieces of a node are hashed one after another.

Defined results: rows without a conversation's number belong to none and are left out; null roles and texts are empty; turns
go by number, nulls first, ties by role, then text; repeated rows are turns of their own; a conversation left without turns
is a member of the root alone; an empty table gives no node; extra columns are ignored. A conversation's digests (36 bytes a
turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Characters of a turn's digest.
DIGEST = 32
#: Neighbouring spines that one task merges.
FAN = 256
#: Rows of a batch, and characters of a piece of numbers, at most.
BATCH_ROWS, PIECE = 20_000, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = (
    "kind string, part long, last boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, key string, parent_key string, path string, tokens array<int>"
)
ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("last", pa.bool_())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [(c, pa.string()) for c in ("ends_sha256", "key", "parent_key", "path")]
    + [("tokens", pa.list_(pa.int32()))]
)


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, nth (from 1), digest, tokens of each turn."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, role_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    return rows.withColumn("nth", F.row_number().over(order)).select("conv_id", "nth", digest.alias("digest"), words.alias("tokens"))


def listed(numbered: DataFrame) -> DataFrame:
    """conv_id, turns (in order)."""
    return numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "tokens"))).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """conv_id, path, tokens of lists (conv_id, turns)."""
    return lists.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["tokens"]).alias("tokens"))


def sequences(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, path, tokens of conversations as they are."""
    return paths(listed(turns(conversations, conv_col, turn_col, role_col, text_col)))


def rebuilt(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, path, tokens, with the first h turns of conversation ``c - c % family`` in place of one's own first h."""
    numbered = turns(conversations, conv_col, turn_col, role_col, text_col)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    given = listed(numbered.filter((F.col("conv_id") % family == 0) & (F.col("nth") < heads))).select(F.col("conv_id").alias("head"), F.col("turns").alias("given"))
    both = listed(numbered).withColumn("head", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h).join(given, "head", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return paths(both.select("conv_id", F.when(F.col("given").isNull(), own).otherwise(F.concat(F.slice("given", F.lit(1), F.col("h")), own)).alias("turns")))


def ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256: the hash of all conv_id of a key, in order, joined by commas. A piece of text at a time is held."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or not i % (PIECE // 20)), len(keys)]
            pieces = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in pairwise(cuts) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(keys: list[str], sums: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])

        at, state = None, None
        for batch in batches:
            keys, sums = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == at:
                    state.update(b",")
                else:
                    if state:
                        keys.append(at)
                        sums.append(state.hexdigest())
                    at, state = key, hashlib.sha256()
                state.update(text.encode())
            yield result(keys, sums)
        if state:
            yield result([at], [state.hexdigest()])

    pieces = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key string, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


class Node:
    """A branching or an end: what is known to lie under it, and, once it has one, the node above."""

    __slots__ = ("above", "children", "depth", "ends", "least", "leaves", "n", "path", "same", "saved")

    def __init__(self, depth: int, path: int, n: int = 0, least: int | None = None, ends: str | None = None, children: int = 0, leaves: int = 0, saved: int = 0):
        self.depth, self.path, self.n, self.least, self.ends, self.children, self.leaves, self.saved = depth, path, n, least, ends, children, leaves, saved
        self.above: Node | None = None
        self.same: Node | None = None  # the node this one was found to be

    def gather(self, other: Node) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)


def itself(node: Node) -> Node:
    while node.same:
        node = node.same
    return node


def common_turns(a: str, b: str) -> int:
    """Turns that two paths share from their first on."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo * DIGEST : mid * DIGEST] == b[lo * DIGEST : mid * DIGEST] else (lo, mid - 1)
    return lo


def met(a: list[Node], b: list[Node]) -> list[Node]:
    """Two chains of nodes on one path, by depth; nodes of one depth become one."""
    if not a or not b:
        return a or b
    out: list[Node] = []
    for node in sorted(a + b, key=lambda x: x.depth):
        if out and out[-1].depth == node.depth:
            kept = out[-1]
            kept.gather(node)
            kept.children, kept.leaves, kept.saved, kept.ends = kept.children + node.children, kept.leaves + node.leaves, kept.saved + node.saved, kept.ends or node.ends
            node.same = kept
        else:
            out.append(node)
    return out


def grow(chains: list[list[Node]], shared: list[int]) -> list[Node]:
    """All nodes over sorted paths, each with the one above it. ``chains[i]``: nodes known on path i, by depth;
    ``shared[i]``: turns that paths i and i + 1 share. Union-find over these edges in descending depth."""
    nodes, root, size = [n for chain in chains for n in chain], list(range(len(chains))), [1] * len(chains)
    open_ = list(chains)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sorted(range(len(shared)), key=lambda i: -shared[i]):
        a, b, depth, tops = find(i), find(i + 1), shared[i], []
        for chain in (open_[a], open_[b]):
            while chain and chain[-1].depth > depth:
                node = chain.pop()
                if chain and chain[-1].depth > depth:
                    node.above = chain[-1]
                else:
                    tops.append(node)
        chain = met(open_[a], open_[b])
        if not chain or chain[-1].depth < depth:
            nodes.append(Node(depth, i))
            chain = [*chain, nodes[-1]]
        for node in tops:
            node.above = chain[-1]
        if size[a] < size[b]:
            a, b = b, a
        root[b], size[a], open_[a], open_[b] = a, size[a] + size[b], chain, []
    for above, node in pairwise(open_[find(0)]):
        node.above = above
    return [n for n in nodes if not n.same]


class Forest:
    """The trie over sorted paths, whole or contracted to its spine."""

    def __init__(self, path: list[str], tokens: list, chains: list[list[Node]], part: int, whole: bool, named: bool):
        self.path, self.tokens, self.part, self.named, self.rows = path, tokens, part, named, []
        self.sums: dict[int, np.ndarray] = {}
        deepest = [(chain[-1] if chain else None) for chain in (chains[0], chains[-1])]
        self.nodes = grow(chains, [common_turns(a, b) for a, b in pairwise(path)])
        if whole:
            top = next(n for n in self.nodes if n.above is None)
            if top.depth:
                top.above = Node(0, top.path)
                self.nodes.append(top.above)
        self.spine: dict[int, bool] = {}  # by id: whether it is above the last path alone
        for last, node in enumerate(deepest if not whole else []):
            node = itself(node) if node else None
            while node:
                self.spine.setdefault(id(node), bool(last))
                node = itself(node.above) if node.above else None
        self._add_up()

    def words(self, node: Node, lo: int, hi: int) -> int:
        """Tokens of the turns lo + 1 to hi of a node's path."""
        if node.path not in self.sums:
            self.sums[node.path] = np.concatenate([[0], np.cumsum(np.asarray(self.tokens[node.path], np.int64))])
        return int(self.sums[node.path][hi] - self.sums[node.path][lo])

    def key(self, node: Node) -> str:
        """Names the node wherever it is met: the hash of its path."""
        return hashlib.md5(self.path[node.path][: node.depth * DIGEST].encode()).hexdigest()

    def _add_up(self) -> None:
        closed = sorted((n for n in self.nodes if id(n) not in self.spine), key=lambda n: -n.depth)
        for node in closed:
            if not node.above:
                continue
            above = node.above = itself(node.above)
            above.gather(node)
            above.children += 1
            above.leaves += node.leaves if node.children else 1
            above.saved += node.saved + (node.n - 1) * self.words(node, above.depth, node.depth)
        for node in closed:
            above = node.above
            waits = above is not None and id(above) in self.spine
            for depth in range(node.depth, above.depth if above else -1, -1):
                at = depth == node.depth
                first = above is not None and depth == above.depth + 1
                parent = None if above is None or first and waits else above.least if first else node.least
                saved = node.saved + ((node.n - 1) * self.words(node, depth - 1, node.depth) if depth else 0)
                self.rows.append(("node", None, None, node.least, depth, parent, node.n, node.children if at else 1, node.leaves if node.children else 1, saved, (at and node.ends) or NO_ENDS, self.key(node) if at and self.named else None, self.key(above) if first and waits else None, None, None))
        if self.spine:
            for node in self.nodes:
                if id(node) in self.spine:
                    self.rows.append(("spine", self.part, self.spine[id(node)], node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, None, None, None, None))
            for i in sorted({0, len(self.path) - 1}):
                self.rows.append(("path", self.part, i > 0, *[None] * 10, self.path[i], self.tokens[i]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.rows), BATCH_ROWS):
            columns = zip(*self.rows[lo : lo + BATCH_ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contracted forest of a partition of sorted rows (path, tokens, n, least, ends_sha256)."""
    path, tokens, n, least, sums = [], [], [], [], []
    for batch in batches:
        for column, out in zip(batch.columns, (path, tokens, n, least, sums), strict=True):
            out += column.to_pylist()
    if path:
        chains = [[Node(len(path[i]) // DIGEST, i, n[i], least[i], sums[i])] for i in range(len(path))]
        yield from Forest(path, tokens, chains, TaskContext.get().partitionId(), whole=False, named=False).batches()


def merged(rows: pa.Table, part: int, whole: bool) -> pa.Table:
    """The forest over some contracted ones, itself contracted unless it is the whole."""
    paths, known = {}, {}
    for row in rows.to_pylist():
        at = row["part"], row["last"]
        if row["kind"] == "path":
            paths[at] = row
        else:
            known.setdefault(at, []).append(row)
    order = sorted(paths)
    chains = []
    for i, at in enumerate(order):
        # a partition of one path has all its nodes on it
        found = sorted(known.get(at, []), key=lambda r: r["depth"])
        chains.append([Node(r["depth"], i, r["n_convs"], r["conv_id"], r["ends_sha256"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in found])
    forest = Forest([paths[at]["path"] for at in order], [paths[at]["tokens"] for at in order], chains, part, whole, named=True)
    return pa.Table.from_batches(forest.batches(), schema=ARROW)


def prefix_trie(rows: DataFrame, broadcast_rows: int = 1_000_000, fan: int = FAN) -> DataFrame:
    """A row for each distinct prefix of the paths of ``rows`` (conv_id, path, tokens)."""
    rows = written(rows.select("conv_id", "path", "tokens", F.md5("path").alias("key")), "paths")
    distinct = rows.groupBy("key", "path", "tokens").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    distinct = written(distinct.join(ends(rows), "key"), "distinct-paths")
    grown = written(distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "tokens", "n", "least", "ends_sha256").mapInArrow(planted, SCHEMA), "forests")
    finished, spines = [grown.filter("kind = 'node'")], grown.filter("kind <> 'node'")
    while (spines.agg(F.max("part")).first()[0] or 0) >= fan:
        groups = spines.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group")
        level = written(groups.applyInArrow(lambda key, table: merged(table, key[0].as_py(), False), SCHEMA), "forests")
        finished, spines = [*finished, level.filter("kind = 'node'")], level.filter("kind <> 'node'")
    last = written(spines.groupBy(F.lit(0).alias("group")).applyInArrow(lambda key, table: merged(table, 0, True), SCHEMA), "forests")
    nodes = last
    for level in finished:
        nodes = nodes.union(level)
    names = last.select("key", "conv_id")
    for level in finished[1:]:
        names = names.union(level.select("key", "conv_id"))
    names = written(names.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("name")), "names")
    if names.count() <= broadcast_rows:
        names = F.broadcast(names)
    return nodes.join(names, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "name")).select(NODE)


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations))


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)), 4294967295), 4294967295)"""
SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT c, nth, md5(length(role)::VARCHAR || ':' || role || text) AS e, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM t
), own AS (
  SELECT c, list({{'e': e, 'k': tokens}} ORDER BY nth) AS own FROM e GROUP BY c
), h AS (
  SELECT c, own, c - c % 20 AS head, {_CRC} % 4 AS h FROM own
), r AS (
  SELECT h.c, coalesce(o.own[1:h.h], []) || h.own[h.h + 1:] AS p FROM h LEFT JOIN own o ON o.c = h.head
), m AS (
  SELECT c, p, unnest(range(0, len(p) + 1)) AS depth FROM r
), k AS (
  SELECT c, p, depth, md5(array_to_string(list_transform(p[1:depth], lambda x: x.e), '')) AS node,
         CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(p[1:depth - 1], lambda x: x.e), '')) END AS above
  FROM m
), n AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, arg_min(p, c) AS p,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(p) = depth) AS ends
  FROM k GROUP BY node
), ch AS (
  SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above
), w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(p[depth].k, 0) AS saved FROM n LEFT JOIN ch USING (node)
), a AS (
  SELECT md5(array_to_string(list_transform(p[1:d], lambda x: x.e), '')) AS node, n_children, saved FROM (SELECT p, n_children, saved, unnest(range(0, depth + 1)) AS d FROM w)
), s AS (
  SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY node
)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (node) LEFT JOIN n up ON up.node = w.above
"""
