"""Near-duplicate groups: MinHash signatures of b-bit symbols and a multi-index Hamming join.

A document is its set of five-word shingles. Its signature has chunks of a few symbols (see ``Layout``), each the low bits
of a minimum hash. Two signatures that differ in at most ``distance`` symbols have, by the pigeonhole principle, a chunk
with at most one difference; each chunk is therefore indexed with every one of its symbols left out, and the equality join
of these keys finds every pair under the signature distance. Pairs are confirmed on the full sets.

Work is done on different texts only: documents with equal sets are one class from the start, known by 128 bits of its set
and numbered when the classes are written.
Keys that more than ``SIDE`` classes share are told to all tasks if they are counted to be few enough, so that their members
stay where they are; only those of other keys are shuffled by key. Within a key, members are
first compared with one member, the key's centre (the one that shares most keys, so the original of a family of copies),
never all with all; the confirmed links give components. Where a key's members then lie in several components, the
members outside its largest component are compared with all members in blocks of bounded size, after those that can have
no further link have been ruled out by what they share (see ``rest_pairs``); only pairs under the signature distance leave
a block. So no link is lost, and a family of copies costs its size, not its square.

A pair is joined with its second side first, so that the original of a large family comes in last and is not moved once for
each of its copies; adaptive execution splits such a family's rows.

Components come from alternating rounds of hooking to the smallest neighbour until nothing changes; links stay
distributed, and each round's result is written to the shared folder.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; fewer than five words are one shingle; repeated rows come out as often as they go in, each with its document's
component; texts that share a doc_id are not linked by it, the smallest doc_id of a component only names it; rows with a null
doc_id are kept, with null as component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import U64, blocks, bounded_batches, mix, ngrams, release, shingle_sets

BITS = 14


class Layout(NamedTuple):
    """Chunks of a signature and symbols of a chunk."""

    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        """Up to this, a pair is found for certain: one chunk must have fewer than two differing symbols."""
        return 2 * self.chunks - 1


#: By the least percentage, highest first: a pair at it differs in more symbols with a probability below 1 in 60,000.
LAYOUTS = {85: Layout(10, 5), 80: Layout(12, 4)}
CHUNKS, WIDTH = LAYOUTS[85]
SYMBOLS, DISTANCE = LAYOUTS[85].symbols, LAYOUTS[85].distance
#: Columns of 128-bit keys: of a row, and of a set of shingles.
ROW, SET = ["row_a", "row_b"], ["set_a", "set_b"]
#: A shingle that at most so many of the texts in question have is rare.
RARE = 64
#: Members of a key on one side of a comparison of blocks.
SIDE = 512
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**62, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _rng.integers(1, 2**62, SYMBOLS, dtype=np.int64).astype(U64)


def layout(percent: int) -> Layout:
    """The layout whose signatures find pairs of at least this similarity."""
    for least, found in LAYOUTS.items():
        if percent >= least:
            return found
    raise ValueError(f"no signature layout finds pairs of {percent} % similarity")


def _segments(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a block (those across documents left out) and where each document's begin; repeats remain."""
    lengths = np.diff(block.ptr)
    grams = ngrams(block.hashes, width)
    counts = np.maximum(lengths - width + 1, 0)
    begins = np.cumsum(counts) - counts
    index = np.repeat(block.ptr[:-1] - begins, counts) + np.arange(counts.sum())
    out = grams[index] if len(index) else np.zeros(0, U64)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        whole = [ngrams(block.hashes[block.ptr[i] : block.ptr[i + 1]], lengths[i])[0] for i in short]
        out = np.insert(out, begins[short], whole)
        counts[short] = 1
    return out, np.cumsum(counts) - counts


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = 5, form: Layout = LAYOUTS[85]) -> DataFrame:
    """doc_id, row_a and row_b (hashes of id and text), n_shingles, set_a and set_b (of its set; null for an empty one), signature
    (binary, two bytes a symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, signs = [], ([], []), []
            for block in blocks(batch.column(3)):
                grams, begins = _segments(block, width)
                ends = np.append(begins[1:], len(grams))
                full = np.flatnonzero(ends > begins)
                symbols = np.zeros((block.hi - block.lo, form.symbols), np.uint16)
                if len(full):
                    for k in range(form.symbols):
                        low = np.minimum.reduceat(grams * _MULTIPLY[k] + _ADD[k], begins[full])
                        symbols[full, k] = (mix(low) & U64((1 << BITS) - 1)).astype(np.uint16)
                for i, (a, b) in enumerate(zip(begins, ends, strict=True)):
                    distinct = np.unique(grams[a:b])
                    n.append(len(distinct))
                    for k, out in enumerate(prints):  # two sums over hashes that are mixed in two ways
                        out.append(int(mix(distinct * _MULTIPLY[k] + _ADD[k]).sum(dtype=U64).view(np.int64)) if len(distinct) else None)
                signs += [row.tobytes() for row in symbols]
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in prints), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *ROW, "n_shingles", *SET, "signature"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, row_a long, row_b long, n_shingles long, set_a long, set_b long, signature binary")


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(name) for k, name in enumerate(ROW)]


class Keyed(NamedTuple):
    """What joins of rows (key, n, ...) with a row a key need: which keys are hot (n above SIDE), if these may be broadcast."""

    broadcast_hot: bool

    def join(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` joined with ``table`` (key, ...), which has each key of theirs once at most. Rows of hot keys are not moved."""
        if not self.broadcast_hot:
            return rows.join(table, "key")
        cold = rows.filter(F.col("n") <= SIDE).join(table, "key")
        hot_keys = rows.filter(F.col("n") > SIDE).select("key").distinct()
        return cold.union(rows.filter(F.col("n") > SIDE).join(F.broadcast(table.join(F.broadcast(hot_keys), "key", "left_semi")), "key"))


def chunk_keys(classes: DataFrame, form: Layout = LAYOUTS[85]) -> DataFrame:
    """key, id: each chunk with each of its symbols left out, as one whole number without collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(rows, *form).astype(np.int64)
            keys = np.empty((rows, *form), np.int64)
            for out in range(form.width):
                rest = [j for j in range(form.width) if j != out]
                keys[:, :, out] = np.arange(form.chunks) * form.width + out
                for j in rest:
                    keys[:, :, out] = (keys[:, :, out] << BITS) | symbols[:, :, j]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(rows), form.symbols)))], names=["key", "id"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "signature").mapInArrow(run, f"key long, id {kind}")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def first_key(a: np.ndarray, b: np.ndarray, form: Layout = LAYOUTS[85]) -> np.ndarray:
    """The first index key that each pair of signatures shares, as chunk * width + symbol left out; -1 for none."""
    differ = (a != b).reshape(-1, *form)
    errors = differ.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    every = np.arange(len(differ))
    return np.where(errors[every, chunk] <= 1, chunk * form.width + differ[every, chunk].argmax(axis=1), -1)


def near(pairs: DataFrame, classes: DataFrame, form: Layout = LAYOUTS[85]) -> DataFrame:
    """Those of the pairs (a, b) whose signatures differ in at most ``distance`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, form.symbols) for c in (2, 3))
            keep = pa.array(np.flatnonzero(_differing(a, b) <= form.distance))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    of = {c: classes.select(F.col("id").alias(c), F.col("signature").alias(f"{c}_signature")) for c in "ab"}
    kind = classes.schema["id"].dataType.simpleString()
    return pairs.join(of["b"], "b").join(of["a"], "a").select("a", "b", "a_signature", "b_signature").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, broadcast_rows: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * common >= percent * union on their full sets. Only documents in a pair are
    shuffled; which they are is broadcast if counted to be few enough, else joined by key."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = written(ids.join(classes.select("id", *ROW), "id"), "pair-ids")
    texts = written(few_texts(docs, ids, broadcast_rows), "pair-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for batch in batches:
            keep = []
            firsts = batch.column(0).to_pylist()
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [s for block in blocks(part.column(3)) for s in shingle_sets(block, width)]
                for i, theirs in enumerate(sets):
                    if firsts[lo + i] != last_id or last_set is None:
                        last_id = firsts[lo + i]
                        last_set = next(s for block in blocks(part.column(2).slice(i, 1)) for s in shingle_sets(block, width))
                    together = np.concatenate([last_set, theirs])
                    together.sort()
                    common = int((together[1:] == together[:-1]).sum())
                    if 100 * common >= percent * (len(together) - common) and len(together):
                        keep.append(lo + i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    of = {c: texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab"}
    return pairs.join(of["b"], "b").join(of["a"], "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60, split_links: int = 1_000_000) -> DataFrame:
    """id, component: the smallest id that each linked id reaches. Rounds of hooking every neighbour to the smallest one,
    first upward, then downward, until the links no longer change. From ``split_links`` links on, the smallest neighbours are
    written before they are joined back: then both sides are shuffled for the join, and a hub's links can be split there."""

    def star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")) if large else both.groupBy("a").agg(F.min("b").alias("least"))
        least = written(least, "least") if split else least
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select("b", "least").union(least.select(F.col("a").alias("b"), "least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        return out.filter("a <> b").distinct()

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    check, split = None, edges.count() >= split_links
    for _ in range(max_rounds):
        edges = written(star(star(edges, True, split), False, split), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == check:
            break
        check = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def few_texts(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """id, text of each of the written ids, from its class's own row; these are broadcast if counted to be few enough, else
    joined by key."""
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, ROW).dropDuplicates(["id"]).select("id", "text")


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """shingle, id: the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                owner = np.repeat(np.arange(block.lo, block.hi), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), batch.column(0).take(pa.array(owner))], names=["shingle", "id"])

    return texts.select("id", "text").mapInArrow(run, f"shingle long, id {texts.schema['id'].dataType.simpleString()}")


def rest_pairs(shared: DataFrame, keyed: Keyed, found: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, broadcast_rows: int, form: Layout) -> DataFrame:
    """Pairs (a, b) under the signature distance that share a key but lie in different components so far.

    Two such texts share a rare shingle, which at most RARE of the texts have, or they don't. Those that do are found by an
    equality join on rare shingles, at most RARE rows each. Those that don't have only frequent shingles in common, so the
    numbers of these bound what they share: a copy of an original that was changed in too many places can't be linked to
    another copy, and is left out before the members of a key are compared.
    """
    placed = shared.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))

    def several(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        return sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members")).filter("parts > 1").drop("parts")

    members = written(keyed.join(placed, several(placed).select("key")), "mixed-keys")
    ids = written(members.select("id").distinct().join(classes.select("id", *ROW), "id"), "mixed-ids")
    rows = written(shingle_rows(few_texts(docs, ids, broadcast_rows), width), "shingles")
    counts = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter(F.col("n") <= RARE), "rare-shingles")
    rare = written(rows.join(counts.filter("n > 1").select("shingle"), "shingle"), "rare-rows")
    alone = counts.filter("n = 1").groupBy(F.col("first").alias("id")).agg(F.count(F.lit(1)).alias("alone"))
    with_few = rare.groupBy("id").agg(F.count(F.lit(1)).alias("with_few"))
    frequent = F.col("n_shingles") - F.coalesce("alone", F.lit(0)) - F.coalesce("with_few", F.lit(0))
    bounded = classes.join(ids.select("id"), "id").join(alone, "id", "left").join(with_few, "id", "left").select("id", "signature", F.col("n_shingles").alias("size"), frequent.alias("common"))
    place = members.select("id", "component").distinct()
    sides = [rare.join(place, "id").select("shingle", F.col("id").alias(c), F.col("component").alias(f"{c}_component")) for c in "ab"]
    by_rare = sides[0].join(sides[1], "shingle").filter("a < b AND a_component <> b_component").select("a", "b").distinct()
    able = written(bounded.filter(100 * F.col("common") >= percent * F.col("size")), "able")
    members = written(members.join(able.select("id"), "id"), "able-members")
    # members outside the largest component, in blocks of SIDE, meet all members of their key, also in blocks
    members = keyed.join(members, several(members)).join(able, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / SIDE)).cast("int"))
    members = written(members, "rest-members")
    strays = members.filter("component <> largest").withColumnRenamed("part", "stray_part")
    parts = strays.groupBy("key", "stray_part").agg(F.max("members").alias("of"))
    work = parts.select("key", "stray_part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("of") / SIDE) - 1).cast("int"))).alias("part"))
    columns = ["key", "stray_part", "part", "side", "id", "component", "signature", "size", "common"]
    left = strays.join(work, ["key", "stray_part"]).withColumn("side", F.lit(0)).select(columns)
    right = members.join(work, ["key", "part"]).withColumn("side", F.lit(1)).select(columns)

    def compare(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        key = rows["key"][0].as_py() >> (BITS * (form.width - 1))
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(-1, form.symbols)
        _, part = np.unique(rows["component"].to_numpy(), return_inverse=True)
        size, common = rows["size"].to_numpy(), rows["common"].to_numpy()
        others, pairs = np.flatnonzero(side == 1), set()
        ids = rows["id"].to_pylist()
        for i in np.flatnonzero(side == 0):
            least = np.minimum(common[i], common[others])
            may = others[(part[others] != part[i]) & (100 * least >= percent * (size[i] + size[others] - least))]
            may = may[_differing(sign[i], sign[may]) <= form.distance]
            may = may[first_key(np.broadcast_to(sign[i], sign[may].shape), sign[may], form) == key]  # in one key of those they share
            pairs.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for j in may)
        kind = rows.schema.field("id").type
        return pa.table({"a": pa.array([x for x, _ in pairs], kind), "b": pa.array([x for _, x in pairs], kind)})

    kind = classes.schema["id"].dataType.simpleString()
    by_key = left.union(right).groupBy("key", "stray_part", "part").applyInArrow(compare, f"a {kind}, b {kind}")
    return by_key.union(near(by_rare, classes, form)).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    form = layout(percent)
    signed = written(signatures(docs, id_col, text_col, width, form), "signatures")
    usable = signed.filter(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
    grouped = usable.groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(*ROW, "n_shingles", "signature")).alias("first"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("id"), *SET, "doc_id", "first.*"), "classes")
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))

    keys = chunk_keys(classes, form)
    counts = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key-counts")
    keyed = Keyed(counts.filter(F.col("n") > SIDE).count() <= broadcast_rows)
    if keyed.broadcast_hot:
        hot = counts.filter(F.col("n") > SIDE)
        marked = keys.join(F.broadcast(hot), "key", "left")
        shared = marked.filter(F.col("n").isNotNull()).union(marked.filter(F.col("n").isNull()).drop("n").join(counts, "key"))
    else:
        shared = keys.join(counts, "key")
    shared = written(shared, "shared-keys")
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = shared.select("key", "id").join(weight, "id")
    centre = written(ranked.groupBy("key").agg(F.max(F.struct("weight", F.col("id").alias("centre")))["centre"].alias("centre")), "centres")
    pairs = keyed.join(shared.select("key", "id", "n"), centre).filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(written(near(pairs, classes, form), "near"), classes, texts, percent, width, broadcast_rows), "confirmed")
    found = written(components(links), "components")
    more = written(rest_pairs(shared, keyed, found, classes, texts, percent, width, broadcast_rows, form), "rest")
    if not more.isEmpty():
        links = links.union(written(confirmed(more, classes, texts, percent, width, broadcast_rows), "confirmed"))
        found = written(components(links), "components")

    # a component is named by the smallest document of all its classes
    linked = written(classes.select("id", "doc_id").join(found, "id"), "linked")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = classes.select("id", *SET, "doc_id").join(linked.join(names, "component").select("id", "name"), "id", "left").select(*SET, F.coalesce("name", "doc_id").alias("component_id"))
    known = usable.select("doc_id", *SET, "n_shingles").join(written(named, "named"), SET).select("doc_id", "n_shingles", "component_id")
    rest = signed.filter(F.col("set_a").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
