"""Vectorised word hashing of Arrow text columns.

A word is a run of bytes outside a separator class. Its 64-bit hash is a polynomial over random byte codes, taken from
prefix sums, so the cost is a few array operations per byte and none per word. Documents are handled in blocks of
bounded size; one document longer than a block makes a block of its own, whose text is hashed in segments that end at
separators, and a word longer than a segment in parts: beyond the text itself it needs eight bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
BLOCK_BYTES = 1 << 18
_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 2**64)


def word_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte codes with A-Z folded when ``lower``; 0 for a separator, which no word byte has."""
    codes = _CODES.copy()
    if lower:
        codes[65:91] = codes[97:123]
    codes[list(separators)] = 0
    return codes


SPACES = bytes([9, 10, 11, 12, 13, 32])
PUNCT = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER_WORDS = word_table(SPACES, lower=True)
LOWER_ALNUM = word_table(PUNCT, lower=True)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = powers(_BASE, BLOCK_BYTES), powers(_INV, BLOCK_BYTES)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads each input bit over the word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Bytes of texts that a batch from Spark to Python holds, about; both sides keep a few copies of it for each core.
BATCH_BYTES = 8 << 20
_BATCHES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Makes batches small unless the session sets their size itself: with texts, the usual one takes a large part of an
    executor's memory beyond its heap."""
    if (spark.conf.get(_BATCHES, None) or "").rstrip("b") == _DEFAULT:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory back to the system, so that a worker that serves many stages does not keep the peak of each."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Block(NamedTuple):
    """Words of documents lo..hi of a batch: ``ptr[i]:ptr[i+1]`` are those of document lo+i."""

    lo: int
    hi: int
    hashes: np.ndarray
    ptr: np.ndarray


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _hash_block(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    codes = table[raw]
    word = codes != 0
    first = np.empty(n, bool)
    first[0] = word[0]
    np.greater(word[1:], word[:-1], out=first[1:])
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] |= word[edge]
    last = np.empty(n, bool)
    last[-1] = word[-1]
    np.greater(word[:-1], word[1:], out=last[:-1])
    last[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    codes *= _POW[0][:n]
    np.cumsum(codes, out=codes)
    h = codes[ends]
    before = codes[starts - 1]
    if len(starts) and starts[0] == 0:
        before[0] = 0
    h = (h - before) * _POW[1][starts]
    return mix(h), np.searchsorted(starts, offsets)


def _hash_long(raw: np.ndarray, table: np.ndarray, segment: int) -> np.ndarray:
    """Word hashes of one text of any length."""
    parts, at, n = [], 0, len(raw)
    while at < n:
        stop = min(n, at + segment)
        if stop < n:
            gaps = np.flatnonzero(table[raw[at:stop]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # a word of a segment's length or more begins here
                h = 0
                while True:
                    gap = np.flatnonzero(table[raw[at + h : at + h + segment]] == 0)
                    if len(gap) or at + h + segment >= n:
                        stop = at + h + int(gap[0]) if len(gap) else n
                        break
                    h += segment
                total = 0
                for lo in range(at, stop, segment):
                    codes = table[raw[lo : min(stop, lo + segment)]] * _POW[0][: min(stop, lo + segment) - lo]
                    total += int(codes.sum(dtype=U64)) * pow(_BASE, lo - at, 2**64)
                parts.append(mix(np.array([total % 2**64], U64)))
                at = stop
                continue
        parts.append(_hash_block(raw[at:stop], np.array([0, stop - at]), table)[0])
        at = stop
    return np.concatenate(parts)


def blocks(column: pa.Array | pa.ChunkedArray, table: np.ndarray = LOWER_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Word hashes of a text column, block by block of at most ``block_bytes`` (itself at most BLOCK_BYTES) or one text."""
    raw, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        if off[hi] - off[lo] > block_bytes:
            h = _hash_long(raw[off[lo] : off[hi]], table, block_bytes)
            ptr = np.array([0, len(h)])
        else:
            h, ptr = _hash_block(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], table)
        yield Block(lo, hi, h, ptr)
        lo = hi


_STEP = 0xD6E8FEB86659FD93


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (fewer positions than words)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= U64(_STEP)
        out += hashes[j : j + m]
    return mix(out)


def shingle_sets(block: Block, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each document; one with fewer words has its whole sequence as the only one."""
    out = []
    for i in range(block.hi - block.lo):
        h = block.hashes[block.ptr[i] : block.ptr[i + 1]]
        out.append(np.unique(ngrams(h, width) if len(h) >= width else ngrams(h, len(h)) if len(h) else h))
    return out
