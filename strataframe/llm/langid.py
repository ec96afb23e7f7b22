"""Language identification by a byte convolutional network.

Bytes (ASCII letters case folded, other ASCII one code) are embedded; filters of widths 2, 3 and 4 pass over windows of
fixed length; each filter's maximum over a window feeds a softmax. The network is trained in numpy on windows of at most
``per_lang`` labelled documents of each language (the documented bound of its sample), chosen by a hash of id and text, so
reruns agree; the windows may lie anywhere in their whole texts, and a document is drawn as often as another. To predict, every window of every whole
text is scored in batches and the windows' probabilities are averaged, weighted by their letters.

For prediction the embedding and the filters are multiplied out into tables by byte pair, so that a window costs two
look-ups and an addition a byte, whatever the embedding's size.

Defined results: a null text or one without a letter is ``und`` with score 0; null languages are not learned; without
any labelled row every text is ``und``; repeated rows are predicted each for itself; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import bounded_batches, release, text_buffers

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
TAIL = WIDTHS[-1] - 1
UNKNOWN = "und"
#: Windows of a training step.
BATCH = 96
CODES = np.zeros(256, np.uint8)
CODES[65:91] = CODES[97:123] = np.arange(1, 27)
CODES[128:] = np.arange(27, 155)
N_CODES = 155


class Model(NamedTuple):
    langs: list[str]
    embedding: np.ndarray  # code, EMBED
    filters: list[np.ndarray]  # by width: width * EMBED, FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters, language
    offset: np.ndarray  # language


def held_out(id_column: Column, mod: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 0


class Windows(NamedTuple):
    """All windows of some texts, by place: where each begins, where its text ends, and whose it is."""

    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    def codes(self, raw: np.ndarray, which: slice | np.ndarray) -> np.ndarray:
        """Codes of some of the windows (WINDOW + TAIL each, 0 beyond a text's end)."""
        places = self.begin[which][:, None] + np.arange(WINDOW + TAIL)
        return CODES[raw[np.minimum(places, len(raw) - 1)]] * (places < self.end[which][:, None])


def windows(offsets: np.ndarray) -> Windows:
    counts = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.repeat(offsets[:-1], counts) + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return Windows(begin, offsets[1:][owner], owner)


def sample(labelled: DataFrame, per_lang: int, draws: int, broadcast_rows: int = 1_000_000) -> list[tuple[str, bytes]]:
    """(language, some of its windows) of at most per_lang different documents of each language: those with the smallest hashes.

    Counts by language give a bound on the hash that about twice as many documents pass, so only those are ranked. Training
    draws ``draws`` windows, languages, documents of a language and windows of a document alike; so of a language no more than
    its share of 2 * draws documents are taken, and of a document as many windows as its share of the draws, chosen by a hash
    where the text is. What comes to the driver is at most 3 * draws windows and two a language, whatever the texts' length."""
    keyed = labelled.withColumn("key", F.xxhash64("doc_id", "text"))
    counts = written(keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    per_lang = min(per_lang, -(-2 * draws // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang + 100) / F.col("n"))  # identical rows pass together, and are one document
    bound = counts.select("lang", (share * 2.0**63 - 1).cast("long").alias("bound"))
    few = keyed.join(F.broadcast(bound) if bound.count() <= broadcast_rows else bound, "lang").filter(F.col("key").bitwiseAND(F.lit((1 << 63) - 1)) <= F.col("bound"))
    order = Window.partitionBy("lang").orderBy(F.col("key").bitwiseAND(F.lit((1 << 63) - 1)), "key")
    chosen = few.select("lang", "key").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    chosen = written(chosen, "lang-sample")
    documents = chosen.groupBy("lang").agg(F.max("n").alias("of"))
    languages = max(1, documents.count())
    chosen = chosen.join(documents, "lang").select("lang", "key", F.ceil(F.lit(draws / languages) / F.col("of")).cast("int").alias("quota"))
    texts = keyed.join(F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen, ["lang", "key"]).dropDuplicates(["lang", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            found, out = windows(off), []
            first = np.searchsorted(found.owner, np.arange(batch.num_rows + 1))
            for i, (key, quota) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                n = int(first[i + 1] - first[i])
                some = np.arange(n) if n <= quota else np.sort(np.random.default_rng(key % 2**64).choice(n, quota, replace=False))
                out.append(found.codes(raw, first[i] + some).tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "windows"])

    rows = texts.select("lang", "text", "key", "quota").mapInArrow(run, "lang string, windows binary").toArrow()
    return sorted((lang, w) for lang, w in zip(rows["lang"].to_pylist(), rows["windows"].to_pylist(), strict=True) if w)


def _pooled(codes: np.ndarray, embedding: np.ndarray, filters: list[np.ndarray]):
    x = embedding[codes]
    values, places, inputs = [], [], []
    for w, width in zip(filters, WIDTHS, strict=True):
        view = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(len(codes), WINDOW, width * EMBED)
        z = view @ w
        at = z.argmax(axis=1)
        values.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        places.append(at)
        inputs.append(np.take_along_axis(view, at[:, :, None], 1))
    return np.concatenate(values, axis=1), places, inputs


def train(examples: list[tuple[str, bytes]], *, steps: int = 300, batch: int = BATCH, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam on cross-entropy; a batch draws languages, of each a document, and of each a window, all alike."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in examples})
    data = np.frombuffer(b"".join(w for _, w in examples), np.uint8).reshape(-1, WINDOW + TAIL)
    ends = np.cumsum([len(w) // (WINDOW + TAIL) for _, w in examples])
    begins = np.append(0, ends[:-1])
    by_lang = [np.array([i for i, (lang, _) in enumerate(examples) if lang == name]) for name in langs]
    total = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.5, (N_CODES, EMBED)), *(rng.normal(0, (width * EMBED) ** -0.5, (width * EMBED, FILTERS)) for width in WIDTHS), np.zeros(total), rng.normal(0, total**-0.5, (total, len(langs))), np.zeros(len(langs))]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), batch)
        doc = np.array([rng.choice(by_lang[k]) for k in label])
        codes = data[rng.integers(begins[doc], ends[doc])]
        embedding, filters, bias, weights, offset = params[0], params[1 : 1 + len(WIDTHS)], *params[-3:]
        pooled, places, inputs = _pooled(codes, embedding, filters)
        hidden = np.maximum(pooled + bias, 0)
        logits = hidden @ weights + offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), label] -= 1
        p /= batch
        back = (p @ weights.T) * (hidden > 0)
        grads = [np.zeros_like(embedding)]
        for k, (w, width) in enumerate(zip(filters, WIDTHS, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads.append(np.einsum("bf,bfk->kf", own, inputs[k]))
            at = (own[:, :, None] * w.T).reshape(batch, FILTERS, width, EMBED)
            touched = np.take_along_axis(codes[:, None, :], places[k][:, :, None] + np.arange(width), 2)
            np.add.at(grads[0], touched.ravel(), at.reshape(-1, EMBED))
        grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] -= (rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model(langs, params[0], params[1 : 1 + len(WIDTHS)], *params[-3:])


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, steps: int = 300) -> Model | None:
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    examples = sample(rows, per_lang, steps * BATCH)
    return train(examples, steps=steps) if examples else None


def pair_tables(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Filter sums by pair of codes: for the two codes at a place (all widths), and for the two after them (3 and 4)."""
    two, three, four = (f.reshape(width, EMBED, FILTERS) for f, width in zip(model.filters, WIDTHS, strict=True))
    by = lambda w: model.embedding @ w
    front = np.concatenate([by(a)[:, None] + by(b)[None] for a, b in ((two[0], two[1]), (three[0], three[1]), (four[0], four[1]))], axis=2)
    behind = np.concatenate([np.repeat(by(three[2])[:, None], N_CODES, 1), by(four[2])[:, None] + by(four[3])[None]], axis=2)
    return front.reshape(N_CODES**2, -1).astype(np.float32), behind.reshape(N_CODES**2, -1).astype(np.float32)


def probabilities(model: Model, tables: tuple[np.ndarray, np.ndarray], codes: np.ndarray, at_once: int = 96) -> np.ndarray:
    """Softmax outputs of all windows."""
    pooled = np.empty((len(codes), FILTERS * len(WIDTHS)), np.float32)
    for lo in range(0, len(codes), at_once):
        part = codes[lo : lo + at_once].astype(np.int32)
        pairs = part[:, :-1] * N_CODES + part[:, 1:]
        z = tables[0].take(pairs[:, :WINDOW], axis=0)
        z[:, :, FILTERS:] += tables[1].take(pairs[:, 2 : WINDOW + 2], axis=0)
        np.max(z, axis=1, out=pooled[lo : lo + at_once])
    logits = np.maximum(pooled + model.bias, 0) @ model.weights + model.offset
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", at_once: int = 2048) -> DataFrame:
    """The columns of ``docs`` that hold id and text, then lang_pred and score."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tables = pair_tables(model) if model else None
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            found = windows(off)
            if model and len(found.owner):
                texts, row = np.unique(found.owner, return_inverse=True)
                sums, weights, plain = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for lo in range(0, len(row), at_once):
                    codes, part = found.codes(raw, slice(lo, lo + at_once)), row[lo : lo + at_once]
                    weight = (codes[:, :WINDOW] != 0).sum(axis=1).astype(np.float64) + 1e-9
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    sums[part[first]] += np.add.reduceat(probabilities(model, tables, codes) * weight[:, None], first, axis=0)
                    weights[part[first]] += np.add.reduceat(weight, first)
                    plain[part[first]] += np.add.reduceat(((codes[:, :WINDOW] > 0) & (codes[:, :WINDOW] < 27)).sum(axis=1), first)
                means = sums / weights[:, None]
                for i, best, p, n in zip(texts.tolist(), means.argmax(axis=1), means.max(axis=1), plain, strict=True):
                    if n or has_letter(batch.column(1)[i].as_py()):
                        langs[i], scores[i] = model.langs[best], float(min(1.0, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: int = 5, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows that are not held out."""
    model = fit(docs.filter(~held_out(F.col(id_col), hold_out)), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, model, id_col=id_col, text_col=text_col).select("doc_id", held_out(F.col("doc_id"), hold_out).alias("held_out"), "lang_pred", "score")


def crc(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())
