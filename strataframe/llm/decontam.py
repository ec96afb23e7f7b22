"""Benchmark decontamination by spaced-seed hashing.

A mask fixes some of the places of a short window and ignores the others, so two passages that differ by a substituted
word still agree under some mask. Hashes of all windows of the benchmark and of the documents under each mask are joined;
around each hit the documents' and the item's words are compared place by place, and an overlap counts if a stretch of it
is long enough and agrees in enough places.

Documents are passed over once: a bit table of fixed size (``BITS``), made from the benchmark's hashes by a distributed
OR, tells which windows can have a partner; only those, merged into stretches with their surrounding words, go to the join
on the hash. A benchmark too large for the table merely lets more windows through. The benchmark's hashes are broadcast
if counted to be at most ``broadcast_rows``, else shuffled.

Words are runs of letters and digits, ASCII case folded, so punctuation does not matter; in scripts that set no spaces each
character is a word.

Items of the same words are one class, named by its smallest item and compared once. One row is returned for each pair of
document and class that overlap, with the number of items of the class.

Defined results: null or empty texts on either side match nothing; an item with fewer words than ``min_words`` matches
where all its words stand in a row, and one that is shorter than the masks has one seed of all its words; an item with fewer
than ``least_words`` words is not looked for; repeated documents give the same rows once; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import LOWER_ALNUM, U64, blocks, bounded_batches, mix, release, text_buffers

#: Places of each mask that must agree. Six places over eleven at most; the first takes exact passages quickly.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 6, 9, 10))
BITS = 25
#: A mask covers so many words at least; a shorter item has a seed of its whole length.
SHORT = len(MASKS[0])
#: Fixed: scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han), and the first bytes of their characters.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_LEADS = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])
#: Words kept on each side of a hit for the comparison; stretches grow to cover all their hits.
AROUND = 96


def spaced(column: pa.Array) -> pa.Array:
    """Texts with a space after each character of a script without spaces; texts without such characters as they are."""
    raw, offsets = text_buffers(column)
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(_LEADS[raw]), "right") - 1)
    if not len(rows):
        return column
    texts = column.to_pylist()
    for i in rows:
        texts[i] = _UNSPACED.sub(r" \1 ", texts[i])
    return pa.array(texts, pa.large_string())


def seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the mask's places in each window; windows begin at all words that leave room."""
    m = len(h) - mask[-1]
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, salt + 1, U64)
    for place in mask:
        out *= U64(0xA24BAED4963EE407)
        out += h[place : place + m]
    return mix(out)


def _bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s >> U64(64 - BITS)).astype(np.int64), ((s >> U64(8)) & U64((1 << BITS) - 1)).astype(np.int64)


def may_match(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    a, b = _bits(s)
    hits = np.flatnonzero((table[a >> 3] >> (a & 7).astype(np.uint8)) & 1)
    b = b[hits]
    return hits[((table[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]


def masks_for(lengths: set[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(salt, mask): all masks, and one over all places for each length of a short item."""
    return [*enumerate(MASKS), *((len(MASKS) + n, tuple(range(n))) for n in sorted(lengths) if n < SHORT)]


def item_seeds(benchmark: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """seed, item_id, item_at; and with seed null the item's words, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for block in blocks(spaced(batch.column(1)), LOWER_ALNUM):
                for i in range(block.hi - block.lo):
                    h = block.hashes[block.ptr[i] : block.ptr[i + 1]]
                    if len(h) < max(1, least_words):
                        continue
                    item = batch.column(0)[block.lo + i].as_py()
                    out[0].append(None), out[1].append(item), out[2].append(0), out[3].append(h.view(np.int64).tolist())
                    for salt, mask in masks_for({len(h)}):
                        s = seeds(h, mask, salt).view(np.int64).tolist()
                        out[0] += s
                        out[1] += [item] * len(s)
                        out[2] += range(len(s))
                        out[3] += [None] * len(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], batch.column(0).type), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], names=["seed", "item_id", "item_at", "words"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    return benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"seed long, item_id {kind}, item_at int, words array<long>")


def bit_table(seed_rows: DataFrame) -> np.ndarray:
    """The table of all seeds: at most 2**BITS bits however large the benchmark is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BITS - 6), U64)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False).view(U64)):
                np.bitwise_or.at(table, at >> 6, U64(1) << (at & 63).astype(U64))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(table[used].view(np.int64))], names=["at", "bits"])

    table = np.zeros(1 << (BITS - 6), np.int64)
    rows = seed_rows.select("seed").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def stretches(docs: DataFrame, table, masks: list[tuple[int, tuple[int, ...]]], id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, words, seeds: stretches of documents around windows that may match, seeds as (seed, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        seed_type = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
        for batch in batches:
            out = [[], [], [], []]
            for block in blocks(spaced(batch.column(1)), LOWER_ALNUM):
                found = []
                for salt, mask in masks:
                    s = seeds(block.hashes, mask, salt)
                    at = may_match(s, bits)
                    doc = np.searchsorted(block.ptr, at, "right") - 1
                    inside = at + mask[-1] < block.ptr[doc + 1]
                    found.append((doc[inside], at[inside], s[at[inside]]))
                doc, at, seed = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(doc):
                    continue
                order = np.argsort(at, kind="stable")
                doc, at, seed = doc[order], at[order], seed[order].view(np.int64)
                cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > AROUND)) + 1
                for part in np.split(np.arange(len(doc)), cuts):
                    d = doc[part[0]]
                    lo, hi = max(block.ptr[d], at[part[0]] - AROUND), min(block.ptr[d + 1], at[part[-1]] + AROUND)
                    out[0].append(batch.column(0)[int(block.lo + d)].as_py())
                    out[1].append(int(lo - block.ptr[d]))
                    out[2].append(block.hashes[lo:hi].view(np.int64).tolist())
                    out[3].append([{"seed": int(s), "at": int(a)} for s, a in zip(seed[part], at[part] - lo, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], seed_type)], names=["doc_id", "start", "words", "seeds"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start int, words array<long>, seeds array<struct<seed: long, at: int>>")


def best_stretch(same: np.ndarray, min_words: int, min_share: float) -> tuple[int, int, int] | None:
    """The longest (from, to, agreeing) that begins and ends with an agreement and agrees in at least ``min_share`` of
    at least ``min_words`` places. Prefix sums of agreement minus the share: a stretch qualifies if its sum is not
    negative, so the furthest end for each begin is found by binary search on the running maximum from behind."""
    at = np.flatnonzero(same)
    if len(at) < min_words * min_share:
        return None
    sums = np.concatenate([[0], np.cumsum(same - min_share)])
    behind = np.maximum.accumulate(sums[at + 1][::-1])[::-1]  # most that any end from here on reaches
    last = np.searchsorted(-behind, -(sums[at] - 1e-9), "right") - 1
    length = np.where(last >= 0, at[np.maximum(last, 0)] + 1 - at, 0)
    i = int(np.argmax(length))
    if length[i] < min_words:
        return None
    lo, hi = int(at[i]), int(at[last[i]]) + 1
    return lo, hi, int(same[lo:hi].sum())


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, min_share: float = 0.8, least_words: int = 1, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_items, doc_from, n_words, n_same: for each overlapping pair its longest overlap, in words.

    An overlap is a run of at least ``min_words`` words, aligned without gaps, that agrees in at least ``min_share`` of its
    places and holds a seed hit; for an item with fewer words, the whole item.
    """
    bounded_batches(docs.sparkSession)
    every = written(item_seeds(benchmark, item_col, item_text_col, least_words), "benchmark")
    words = written(every.filter(F.col("seed").isNull()).groupBy(F.col("words").alias("item_words")).agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items")), "items")
    seed_rows = every.filter(F.col("seed").isNotNull()).select("seed", "item_id", "item_at").distinct().join(words.select("item_id").distinct(), "item_id", "left_semi")
    seed_rows = written(seed_rows, "item-seeds")
    small = seed_rows.count() <= broadcast_rows
    table = docs.sparkSession.sparkContext.broadcast(bit_table(seed_rows))
    short = {r[0] for r in words.select(F.size("item_words")).filter(F.size("item_words") < SHORT).distinct().collect()}  # five lengths at most
    found = written(stretches(docs, table, masks_for(short), id_col, text_col).dropDuplicates(["doc_id", "start", "words"]).withColumn("stretch", F.xxhash64("doc_id", "start", "words")), "stretches")
    hits = found.select("doc_id", "stretch", F.explode("seeds").alias("s")).select("doc_id", "stretch", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    pairs = hits.join(F.broadcast(seed_rows) if small else seed_rows, "seed").select("doc_id", "stretch", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    compared = pairs.join(found.drop("seeds"), ["doc_id", "stretch"]).join(F.broadcast(words) if small else words, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, results = [], []
            shifts, starts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                doc, item = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                lo, hi = max(0, shifts[i]), min(len(doc), shifts[i] + len(item))
                least, share = (min_words, min_share) if len(item) >= min_words else (len(item), 1.0)
                if found_at := best_stretch(doc[lo:hi] == item[lo - shifts[i] : hi - shifts[i]], least, share):
                    keep.append(i)
                    results.append((starts[i] + lo + found_at[0], found_at[1] - found_at[0], found_at[2]))
            columns = list(zip(*results, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "item_id", "doc_from", "n_words", "n_same"])

    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    overlaps = compared.select("doc_id", "item_id", "shift", "start", "words", "item_words").mapInArrow(verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_from long, n_words long, n_same long")
    best = F.max(F.struct("n_words", "n_same", (-F.col("doc_from")).alias("back")))
    numbers = words.groupBy("item_id").agg(F.sum("n_items").alias("n_items"))  # one class, but for an id that is given to several texts
    found = overlaps.groupBy("doc_id", "item_id").agg(best.alias("b")).join(F.broadcast(numbers) if small else numbers, "item_id")
    return found.select("doc_id", "item_id", "n_items", (-F.col("b.back")).alias("doc_from"), F.col("b.n_words").alias("n_words"), F.col("b.n_same").alias("n_same"))
