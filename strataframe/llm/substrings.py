"""Substring deduplication: words covered by a window of ``length`` words that also starts elsewhere are removed.

The minimiser of a window is the least hash of its runs of ``gram`` words. Consecutive windows with one minimiser (a
super-k-mer) travel as one packed string, the words from the first window's begin to the last one's end, to the bucket of
that minimiser; there the windows are sorted by hash and those of one hash compared word for word, so counts are exact.

Two equal windows have their minimiser at two places. Places are counted first, so a stretch whose minimiser has one place
in all documents stays at home: a bit table of fixed size (16 MB, the same for any input) says which may have more. Where it
fills up, more strings travel than need to, and none is lost. A minimiser with very many places (a passage or a whole
document that a large part of the corpus shares) would make a hot bucket: its windows are counted as rows of their own, by
two 64-bit hashes, added up within each task before they are shuffled. There are at most ``MOST_HOT`` such minimisers.
What is found goes back to the documents as bits for each string's windows.

Defined results: a null or empty text, or one without words, has no words and the empty string's hash; fewer than
``length`` words make no window; repeated rows and rows that share a doc_id count as documents of their own, so their
windows occur twice; a window that occurs twice in one text, overlaps included, is removed there; a null doc_id is kept; an
empty table gives an empty result; extra columns are ignored. Beyond a text itself a task needs about 60 bytes a word of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import SPACES, U64, blocks, bounded_batches, mix, ngrams, release, text_buffers, word_table

LENGTH, GRAM = 35, 6
#: Windows of a packed string at most: their bits make one whole number.
STRETCH = 32
#: Bits of the table of minimisers with several places.
TABLE_BITS = 27
#: A minimiser with more places than this, and than a MOST_HOT-th of all, is hot.
LEAST_HOT, MOST_HOT = 1_000, 4_000_000
#: Repeated windows under hot minimisers that are told to all tasks (16 bytes each); beyond, they are joined.
MOST_TOLD = 2_000_000
WORDS = word_table(SPACES, lower=False)
ROW = ["hi", "lo"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes, and 128 bits of both: rows that are equal throughout have equal results."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key: list[Column] = [F.xxhash64(F.lit(k), F.col(id_col), body).alias(name) for k, name in enumerate(ROW)]
    return docs.select(*key, F.col(id_col).alias("doc_id"), body.cast("binary").alias("text"))


def sliding(values: np.ndarray, width: int, least: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or what the function says) of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = least(values[:-span], values[span:])
        span *= 2
    return least(values[: span - width], values[width - span :]) if width > span else values


class Minimisers(NamedTuple):
    least: np.ndarray  # by word: the minimiser of the window that begins there; 0 if none does
    places: np.ndarray  # a minimiser for each place where it is the least of some window


def minimisers(hashes: np.ndarray, ptr: np.ndarray, length: int, gram: int) -> Minimisers:
    """Of the documents whose words are ``hashes[ptr[i]:ptr[i+1]]``."""
    n = len(hashes) - length + 1
    if n < 1:
        return Minimisers(np.zeros(0, U64), np.zeros(0, U64))
    grams, width = np.maximum(ngrams(hashes, gram), U64(1)), length - gram + 1
    least = sliding(grams, width).copy()
    least[np.arange(n) + length > np.repeat(ptr[1:], np.diff(ptr))[:n]] = 0
    edge = np.zeros(width - 1, U64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return Minimisers(least, grams[grams == most])


class Stretches(NamedTuple):
    """Runs of windows that share a minimiser, in pieces of STRETCH at most: first window, number of windows, minimiser."""

    begin: np.ndarray
    windows: np.ndarray
    key: np.ndarray


def stretches(least: np.ndarray) -> Stretches:
    if not len(least):
        return Stretches(*(np.zeros(0, np.int64),) * 2, np.zeros(0, U64))
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    long = np.diff(np.append(first, len(least)))
    first, long = first[least[first] > 0], long[least[first] > 0]
    pieces = -(-long // STRETCH)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + nth * STRETCH
    return Stretches(begin, np.minimum(np.repeat(long, pieces) - nth * STRETCH, STRETCH), least[begin])


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = WORDS[raw] != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = word & edge[:-1], word & edge[1:]
    first[0], last[-1] = word[0], word[-1]
    first[1:] |= word[1:] & ~word[:-1]
    last[:-1] |= word[:-1] & ~word[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def window_hashes(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, over words hashed in two ways."""
    return ngrams(hashes, length), ngrams(mix(hashes + U64(0x632BE59BD9B4E019)), length)


class Table(NamedTuple):
    """What all tasks know of minimisers: the hot ones in order, and the bits of those that may have several places."""

    hot: np.ndarray
    bits: np.ndarray

    def travels(self, keys: np.ndarray) -> np.ndarray:
        low = keys & U64((1 << TABLE_BITS) - 1)
        return (self.bits[(low >> U64(6)).astype(np.int64)] >> (low & U64(63)) & U64(1) == 1) & ~among(keys, self.hot)


def repeated_places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, n: minimisers with several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimisers(b.hashes, b.ptr, length, gram).places for b in blocks(batch.column(0), WORDS)]
            keys, n = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
            release()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def table(counts: DataFrame, least_hot: int) -> Table:
    """``counts`` is read three times."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(least_hot, total // MOST_HOT)
    hot = np.sort(counts.filter(F.col("n") > bound).select("key").toArrow()["key"].to_numpy().view(U64))
    low = F.expr(f"key & {(1 << TABLE_BITS) - 1}L")
    words = counts.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {(1 << TABLE_BITS) - 1}L) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << TABLE_BITS - 6, U64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().view(U64)
    return Table(hot, bits)


def packed(docs: DataFrame, known: Broadcast[Table], length: int, gram: int) -> DataFrame:
    """key, hi, lo, start, words: the strings that travel, and which window of which row each begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            for block in blocks(batch.column(2), WORDS):
                runs = stretches(minimisers(block.hashes, block.ptr, length, gram).least)
                begin, windows, key = (x[known.value.travels(runs.key)] for x in runs)
                if not len(begin):
                    continue
                part = raw[off[block.lo] : off[block.hi]]
                first, last = spans(part, off[block.lo : block.hi + 1] - off[block.lo])
                doc = np.searchsorted(block.ptr, begin, "right") - 1
                body = part.tobytes()
                for lo in range(0, len(begin), 20_000):
                    here = slice(lo, lo + 20_000)
                    ends = last[begin[here] + windows[here] + length - 2]
                    strings = [b" ".join(body[a:b].split()) for a, b in zip(first[begin[here]].tolist(), ends.tolist(), strict=True)]
                    at = pa.array(doc[here] + block.lo)
                    columns = [pa.array(key[here].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array((begin - block.ptr[doc])[here]), pa.array(strings, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", *ROW, "start", "words"])
            release()

    return docs.select(*ROW, "text").mapInArrow(run, "key long, hi long, lo long, start long, words binary")


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 4096) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b on are the same, pair by pair."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), step):
        n = size[lo : lo + step]
        begin = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(begin, n)
        out[lo : lo + step] = ~np.logical_or.reduceat(raw[np.repeat(a[lo : lo + step], n) + inner] != raw[np.repeat(b[lo : lo + step], n) + inner], begin)
    return out


def repeated_windows(strings: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """For each packed string the bits of those of its windows that occur more than once among all windows given."""
    raw, off = text_buffers(strings)
    first, last = spans(raw, off)
    hashes = np.concatenate([np.zeros(0, U64), *(b.hashes for b in blocks(strings, WORDS))])
    ptr = np.searchsorted(first, off)
    out = np.zeros(len(off) - 1, np.int64)
    prints = ngrams(hashes, length)
    row = np.repeat(np.arange(len(off) - 1), np.diff(ptr))[: len(prints)]
    at = np.flatnonzero(np.arange(len(prints)) + length <= ptr[row + 1])
    at = at[np.argsort(prints[at], kind="stable")]
    same = prints[at][1:] == prints[at][:-1]
    a, b = at[:-1][same], at[1:][same]
    size = last[a + length - 1] - first[a]
    alike = (size == last[b + length - 1] - first[b])
    alike[alike] = _equal(raw, first[a[alike]], first[b[alike]], size[alike])
    twice = np.unique(np.concatenate([a[alike], b[alike]]))
    odd = np.isin(prints, prints[a[~alike]]) if not alike.all() else np.zeros(len(prints), bool)
    if odd.any():  # one hash for different windows: told apart by their words
        by_words: dict[bytes, list[int]] = {}
        for i in np.intersect1d(np.flatnonzero(odd), at):
            by_words.setdefault(raw[first[i] : last[i + length - 1]].tobytes(), []).append(i)
        twice = np.union1d(twice, [i for group in by_words.values() if len(group) > 1 for i in group]).astype(np.int64)
    if len(twice):
        out[:] = np.bincount(row[twice], weights=2.0 ** (twice - ptr[row[twice]]), minlength=len(out)).astype(np.int64)
    return out


def counted(strings: DataFrame, length: int) -> DataFrame:
    """hi, lo, start, bits: each bucket's windows counted. A task gets whole buckets in order and holds a batch and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: pa.Table) -> pa.RecordBatch:
            bits = repeated_windows(rows["words"], length)
            found = pa.array(np.flatnonzero(bits))
            return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(found) for c in [*ROW, "start"]), pa.array(bits).take(found)], names=[*ROW, "start", "bits"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or kept and kept[-1].column(0)[-1].as_py() != keys[0]:
                yield result(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
            release()
        if kept:
            yield result(pa.Table.from_batches(kept))

    parts = strings.repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(run, "hi long, lo long, start long, bits long")


def _hot_windows(block, known: Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows with hot minimisers begin in a block, and their two hashes."""
    least = minimisers(block.hashes, block.ptr, length, gram).least
    at = np.flatnonzero(among(least, known.hot))
    if not len(at):
        return at, np.zeros(0, U64), np.zeros(0, U64)
    a, b = window_hashes(block.hashes, length)
    return at, a[at], b[at]


def hot_repeats(docs: DataFrame, known: Broadcast[Table], length: int, gram: int) -> DataFrame:
    """a, b: hashes of the windows with hot minimisers that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hot_windows(block, known.value, length, gram)[1:] for block in blocks(batch.column(0), WORDS)]
            a, b = (np.concatenate([np.zeros(0, U64), *(x[k] for x in found)]) for k in (0, 1))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(np.diff(np.append(new, len(a))))], names=["a", "b", "n"])
            release()

    return docs.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b")


def hot_places(docs: DataFrame, known: Broadcast[Table], repeats: DataFrame, length: int, gram: int) -> DataFrame:
    """hi, lo, start, bits (1) of every window that is among the repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), WORDS):
                at, a, b = _hot_windows(block, known.value, length, gram)
                doc = np.searchsorted(block.ptr, at, "right") - 1
                rows = pa.array(doc + block.lo)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - block.ptr[doc])], names=["a", "b", *ROW, "start"])

    return docs.select(*ROW, "text").mapInArrow(run, "a long, b long, hi long, lo long, start long").join(repeats, ["a", "b"]).select(*ROW, "start").distinct().withColumn("bits", F.lit(1).cast("long"))


class Told(NamedTuple):
    """Repeated windows under hot minimisers, ordered by their first hash."""

    a: np.ndarray
    b: np.ndarray

    def have(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.a, a), np.searchsorted(self.a, a, "right")
        out = np.zeros(len(a), bool)
        for step in range(int((hi - lo).max(initial=0))):
            at = np.minimum(lo + step, max(len(self.a) - 1, 0))
            out |= (lo + step < hi) & (self.b[at] == b)
        return out


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, least_hot: int = LEAST_HOT, most_told: int = MOST_TOLD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    if not 1 <= gram <= length:
        raise ValueError("a window holds at least one run of gram words")
    bounded_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    rows = keyed(docs, id_col, text_col)
    known = share(table(written(repeated_places(rows, length, gram), "places"), least_hot))
    found = counted(packed(rows, known, length, gram), length)
    told = Told(*(np.zeros(0, U64),) * 2)
    if len(known.value.hot):
        repeats = written(hot_repeats(rows, known, length, gram), "hot-windows")
        if repeats.count() <= most_told:
            all_of_them = repeats.sort("a", "b").toArrow()
            a, b = (all_of_them[c].to_numpy().view(U64) for c in "ab")
            order = np.argsort(a, kind="stable")
            told = Told(a[order], b[order])
        else:
            found = found.union(hot_places(rows, known, repeats, length, gram))
    hot = share(told)
    # rows that are equal throughout find the same bits; each string's once
    marks = written(found.groupBy(*ROW).agg(F.collect_set(F.struct("start", "bits")).alias("marks")), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            covers: dict[int, list[np.ndarray]] = {}
            for i, marked in enumerate(batch.column(2).to_pylist()):
                if marked:
                    start, bits = (np.array([m[c] for m in marked], np.int64) for c in ("start", "bits"))
                    which, window = np.nonzero(bits[:, None] >> np.arange(STRETCH) & 1)
                    covers[i] = [start[which] + window]
            if len(hot.value.a):
                for block in blocks(texts, WORDS):
                    at, a, b = _hot_windows(block, known.value, length, gram)
                    at = at[hot.value.have(a, b)]
                    doc = np.searchsorted(block.ptr, at, "right") - 1
                    for i in np.unique(doc):
                        covers.setdefault(block.lo + int(i), []).append(at[doc == i] - block.ptr[i])
            n, gone, kept = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                words = text.split()
                n.append(len(words))
                if i in covers:
                    starts = np.unique(np.concatenate(covers[i]))
                    change = np.zeros(len(words) + 1, np.int64)
                    change[starts] += 1
                    change[starts + length] -= 1
                    stay = np.cumsum(change[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(marks, ROW, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(words) - {LENGTH - 2})) AS i,
         unnest(list_transform(range(1, len(words) - {LENGTH - 2}), lambda i: array_to_string(words[i:i + {LENGTH - 1}], ' '))) AS words
  FROM texts WHERE len(words) >= {LENGTH}
), repeated AS (
  SELECT r, i FROM windows WHERE words IN (SELECT words FROM windows GROUP BY words HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT r, i + k AS i FROM repeated, range({LENGTH}) AS t(k)
), placed AS (
  SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM placed ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
