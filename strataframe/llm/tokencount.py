"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens, whose token counts don't depend on their neighbours. A compact table of frequent
pre-tokens and their counts is broadcast; a pre-token that it lacks is encoded once by the worker's tokenizer and kept in
the worker's cache, of bounded size. Nothing is shuffled.

The frequent tier holds the ``hot`` most frequent pre-tokens of all texts (a proven bound for what is broadcast). Each task
counts its own, prunes its table as it fills, and sends its ``hot`` most frequent ones on; these summaries are added up. No
pre-token of a text is shuffled. The tier is a cache: what is in it changes the speed alone, since what it lacks is encoded.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text are one token each, as the
library treats them by default; repeated rows count each for itself; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded_batches


#: Fixed: the pre-token pattern of byte-level BPE, with classes that ``pattern`` fills in.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


#: Pre-tokens of at most so many characters are kept, and so many of them: when a worker's cache is full, it starts anew.
CACHE_ENTRIES = 400_000
LONGEST_HOT = 64


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary of a byte-level model: itself where it is
    printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


class Lengths(dict):
    """Token counts of pre-tokens: a frequent tier, then misses encoded on demand and kept in a bounded cache."""

    def __init__(self, tokenizer, hot: dict[str, int], cache_entries: int):
        super().__init__(hot)
        self._hot, self._model, self._most = hot, tokenizer.model, cache_entries + len(hot)

    def __missing__(self, pre_token: str) -> int:
        n = len(self._model.tokenize(pre_token.encode().decode("latin-1").translate(BYTE_CHARS)))
        if len(pre_token) <= LONGEST_HOT:
            if len(self) >= self._most:
                self.clear()
                self.update(self._hot)
            self[pre_token] = n
        return n


def character_classes(tokenizer) -> dict[str, str]:
    """Letters, numbers and white space of the basic plane as the library itself takes them, written out as ranges for
    the standard library's matcher: Unicode tables differ between libraries and versions."""
    plane = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def joins(mark: str) -> set[str]:
        """Characters that make one pre-token with ``mark`` before them."""
        whole = {start for _, (start, end) in cut("".join(f"{mark}{c}\n\n\n" for c in plane)) if start % 5 == 0 and end == start + 2}
        return {c for i, c in enumerate(plane) if 5 * i in whole}

    letters, numbers = joins("a"), joins("1")
    space = set(plane) - letters - numbers - joins("-")

    def ranges(members: set[str]) -> str:
        out, codes = [], sorted(map(ord, members))
        for c in codes:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)

    return {"L": ranges(letters), "N": ranges(numbers), "S": ranges(space)}


class Cutter:
    """Cuts texts into special strings and pre-tokens as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        classes = character_classes(self.tokenizer)
        self.basic = re.compile(PRE_TOKEN.format(**classes)).findall
        self.words = re.compile("[{S}]*[^{S}]+|[{S}]+".format(**classes)).findall
        self.library = self.tokenizer.pre_tokenizer.pre_tokenize_str

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings. No pre-token begins before white space and ends after it, so words
        with characters beyond the basic plane, with the white space before them, can go through the library's own cut."""
        if basic(text):
            return self.basic(text)
        out: list[str] = []
        for word in self.words(text):
            out += self.basic(word) if max(word) < "\U00010000" else [word[a:b] for _, (a, b) in self.library(word)]
        return out

    def __call__(self, text: str) -> tuple[int, list[list[str]]]:
        """The number of special strings, and the pre-tokens of what is between them."""
        if self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1, list(map(self.plain, parts))
        return 0, [self.plain(text)]


@lru_cache(maxsize=2)
def load(path: str) -> Cutter:
    return Cutter(path)


def basic(text: str) -> bool:
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


class Counts:
    """Counts the tokens of texts."""

    def __init__(self, path: str, hot: dict[str, int]):
        self.cut = load(path)
        self.lengths = Lengths(self.cut.tokenizer, hot, CACHE_ENTRIES)

    def __call__(self, text: str) -> int:
        special, parts = self.cut(text)
        return special + sum(sum(map(self.lengths.__getitem__, p)) for p in parts)


def frequent(docs: DataFrame, path: str, text_col: str, hot: int) -> dict[str, int]:
    """The frequent tier: pre-tokens and their token counts. At most ``hot`` rows a task are shuffled, and ``hot`` come here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = load(path)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for part in cut(text)[1]:
                        seen.update(part)
                if len(seen) > 16 * hot:
                    seen = Counter(dict(seen.most_common(8 * hot)))
        top = [(t, n) for t, n in seen.most_common(hot) if len(t) <= LONGEST_HOT and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pre_token", "n"])

    found = docs.select(text_col).mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    top = [r.pre_token for r in found.orderBy(F.desc("n"), "pre_token").limit(hot).collect()]
    lengths = Lengths(load(path).tokenizer, {}, CACHE_ENTRIES)
    return {t: lengths[t] for t in top}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, tokenizer_path, text_col, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer_path, tier.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes, n_tokens = [len(t.encode()) for t in texts], list(map(counts, texts))
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n, pa.array([x > limit for x in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
