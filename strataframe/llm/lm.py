"""A gated recurrent language model over whole documents.

Words are counted over all training documents. The most frequent words form the network's vocabulary; the output softmax
is factored into classes of words, and a word outside the vocabulary has the network's probability of "other" times its
smoothed share of all other words, so the model is a distribution over all words. The network learns in numpy by truncated
backpropagation: state runs on from window to window through a document, gradients stop at a window's edge. In training a
document's state begins anew after every ``SEGMENT`` tokens, so that a long document is learned in several lanes at once
instead of alone in one; what is lost is the state across one token in so many.

All training documents give gradient steps, each once. They are dealt to shards of about ``SHARD_TOKENS`` tokens by a hash
of id and text and stand in its order there; the shards of a round train side by side from the same parameters and are
averaged. What is learned thus depends on the rows alone, not on how they are partitioned (but for the last bits of sums).
Scoring carries state through each whole document.

Counts are exact and stay distributed: words with at least a count that at most ``HOT`` words reach are broadcast (a
proven bound); the rest of a document's words meet their counts in a join on the word's hash, added up by document.

Defined results: a null or empty text is its end token alone; with no training documents the unigram has no counts and
every token has the same probability; repeated rows are scored each for itself; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .store import written
from .tokens import U64, blocks, release

HOT = 1 << 19
#: The output classes: the first holds "other" alone, each other one PER_CLASS words, the end among them.
CLASSES, PER_CLASS, HIDDEN = 25, 64, 24
OTHER, WORDS = 0, (CLASSES - 1) * PER_CLASS
END_HASH = np.uint64(0x5EED0E0D)
#: Bound on logits, so that exponentials stay finite without a pass for the largest.
MOST_LOGIT = np.float32(60)
CHUNK = 4096
#: Adagrad's sums begin here: small, as gradients of a token's mean loss are.
FIRST_MOMENT = 1e-7
#: Training tokens of a shard, the share of the corpus that one run of gradient steps takes in order.
SHARD_TOKENS = 1 << 21
#: Training starts anew from a zero state after so many tokens of a document; scoring never does.
SEGMENT = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, n: of the words and ends of (doc_id, text, held_out) rows that aren't held out; combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [b.hashes for b in blocks(batch.column(0))]
            words, n = np.unique(np.concatenate([*parts, np.full(batch.num_rows, END_HASH, U64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """Counts of frequent words by sorted hash, their places in the network's vocabulary (OTHER: none), and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    start: np.ndarray  # by leading bits, where hashes begin
    total: int  # tokens
    distinct: int
    end: int  # place of the end token
    inside: np.ndarray  # counts by place
    inside_distinct: int
    complete: bool  # no other word was seen in training

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not among the frequent ones."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return out
        bucket = (h >> U64(44)).astype(np.int64)
        at, stop = self.start[bucket], self.start[bucket + 1]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            here = at[open_]
            hit = self.hashes[here] == h[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def places_of(self, h: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
        """Place of each hash in the network's vocabulary."""
        found = self.find(h) if found is None else found
        return np.where(found >= 0, self.places[found], OTHER) if len(self.places) else np.zeros(len(h), np.int64)


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """From written counts; what comes to the driver is at most ``hot`` words and a few hundred sums."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(F.log2("n") * 16).cast("int")
    least, so_far = 1 << 62, 0
    for r in counts.groupBy(level.alias("level")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("level")).collect():
        if so_far + r.v > hot:
            break
        so_far, least = so_far + r.v, r.least
    rows = counts.filter(F.col("n") >= least).toArrow()
    h, n = rows["hash"].to_numpy().view(U64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    rank = np.lexsort((h, -n, h != END_HASH))[:WORDS]  # the end first, then by count
    rank = rank[np.argsort(-n[rank], kind="stable")]
    places = np.zeros(len(h), np.int32)
    places[rank] = np.arange(1, len(rank) + 1)
    inside = np.zeros(WORDS + 1)
    inside[1 : len(rank) + 1] = n[rank]
    inside[OTHER] = totals.n - n[rank].sum()
    end = int(places[np.searchsorted(h, END_HASH)]) if len(h) else 1
    start = np.searchsorted(h, np.arange((1 << 20) + 1, dtype=object).astype(U64) << U64(44)) if len(h) else np.zeros((1 << 20) + 1, np.int64)
    start[-1] = len(h)
    return Vocabulary(h, n, places, start.astype(np.int64), int(totals.n), int(totals.v), end, inside, len(rank), so_far == totals.v)


def initial(vocab: Vocabulary, seed: int = 11) -> np.ndarray:
    """All parameters in one vector; output biases start at the words' frequencies, places without a word at next to none."""
    rng = np.random.default_rng(seed)
    h, smooth = HIDDEN, np.where(vocab.inside > 0, vocab.inside + 0.5, 1e-6)
    smooth[OTHER] = vocab.inside[OTHER] + 0.5
    words = smooth[1:].reshape(CLASSES - 1, PER_CLASS)
    kinds = np.concatenate([smooth[:1], words.sum(1)])
    parts = [rng.normal(0, 0.3, (WORDS + 1) * 3 * h), rng.normal(0, h**-0.5, 3 * h * h), np.zeros(CLASSES * h), np.log(kinds / kinds.sum()), np.zeros((CLASSES - 1) * h * PER_CLASS), np.log(words / words.sum(1, keepdims=True)).ravel()]
    return np.concatenate(parts).astype(np.float32)


class Tape(NamedTuple):
    """What a window's states were made from; a column for each token, step after step."""

    before: np.ndarray
    z: np.ndarray
    r: np.ndarray
    new: np.ndarray
    u: np.ndarray  # the recurrent part of the candidate
    open: np.ndarray  # whether each gate is off its bounds


class Net:
    """Views of a parameter vector: input rows (place, gates), recurrence, class and word outputs. Gates are piecewise linear.

    Values are kept with a column for each token, so that steps work on whole runs of memory.
    """

    def __init__(self, vector: np.ndarray):
        h, at = HIDDEN, 0
        self.views = []
        for shape in ((WORDS + 1, 3 * h), (3 * h, h), (CLASSES, h), (CLASSES, 1), (CLASSES - 1, h, PER_CLASS), (CLASSES - 1, PER_CLASS)):
            n = int(np.prod(shape))
            self.views.append(vector[at : at + n].reshape(shape))
            at += n
        self.inputs, self.recur, self.to_class, self.class_bias, self.to_word, self.word_bias = self.views

    def forward(self, rows: np.ndarray, edges: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, Tape | None]:
        """All states of a window whose steps are ``edges[t]:edges[t+1]``, the last state, and the tape if it is kept."""
        h, m = HIDDEN, len(rows)
        x = self.inputs.take(rows, axis=0).T.copy()
        states, u_all = np.empty((h, m), np.float32), np.empty((h, m if keep else 0), np.float32)
        before = np.empty((h, m if keep else 0), np.float32)
        resets = np.add.reduceat(fresh, edges[:-1]) if m else fresh
        for t in range(len(edges) - 1):
            lo, hi = edges[t], edges[t + 1]
            state = state[:, : hi - lo]
            if resets[t]:
                state = state * ~fresh[lo:hi]
            u = self.recur @ state
            gates, candidate = x[: 2 * h, lo:hi], x[2 * h :, lo:hi]
            gates += u[: 2 * h]
            gates *= 0.25
            gates += 0.5
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            if keep:
                before[:, lo:hi], u_all[:, lo:hi] = state, u[2 * h :]
            u = u[2 * h :]
            u *= gates[h:]
            candidate += u
            np.tanh(candidate, out=candidate)
            after = states[:, lo:hi]
            np.subtract(state, candidate, out=after)
            after *= gates[:h]
            after += candidate
            state = after
        gates = x[: 2 * h]
        return states, state, Tape(before, gates[:h], gates[h:], x[2 * h :], u_all, (gates > 0) & (gates < 1)) if keep else None

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: Net | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets; with ``grads``, those of the loss are added and the states' returned."""
        kind = (targets + (PER_CLASS - 1)) // PER_CLASS
        logits = self.to_class @ states
        logits += self.class_bias
        np.minimum(logits, MOST_LOGIT, out=logits)
        every = np.arange(len(targets))
        out = logits[kind, every]
        np.exp(logits, out=logits)
        sums = logits.sum(axis=0)
        out -= np.log(sums)
        back = None
        if grads is not None:
            logits /= sums
            logits[kind, every] -= 1
            grads.to_class += logits @ states.T
            grads.class_bias += logits.sum(axis=1, keepdims=True)
            back = self.to_class.T @ logits
        inside = np.flatnonzero(kind)
        order = inside[np.argsort(kind[inside].astype(np.int8), kind="stable")]
        edges = np.searchsorted(kind[order], np.arange(1, CLASSES + 1))
        by_kind, word = states.T[order], (targets[order] - 1) % PER_CLASS
        more = np.empty_like(by_kind) if grads is not None else None
        for c in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[c], edges[c + 1]
            s, every = by_kind[lo:hi], np.arange(hi - lo)
            inner = s @ self.to_word[c]
            inner += self.word_bias[c]
            np.minimum(inner, MOST_LOGIT, out=inner)
            picked = inner[every, word[lo:hi]]
            np.exp(inner, out=inner)
            total = inner @ _ONES  # quicker than a sum over a short axis
            out[order[lo:hi]] += picked - np.log(total)
            if grads is not None:
                inner /= total[:, None]
                inner[every, word[lo:hi]] -= 1
                grads.to_word[c] += s.T @ inner
                grads.word_bias[c] += inner.sum(axis=0)
                np.matmul(inner, self.to_word[c].T, out=more[lo:hi])
        if grads is not None and len(order):
            rows = back.T.copy()
            rows[order] += more
            back = rows.T.copy()
        return out, back

    def backward(self, back: np.ndarray, edges: np.ndarray, fresh: np.ndarray, tape: Tape, grads: Net) -> np.ndarray:
        """Gradients of the input rows (a row for each token); that of the recurrence is added to ``grads``."""
        h = HIDDEN
        by_new = (1 - tape.z) * (1 - tape.new * tape.new)
        by_z = (tape.before - tape.new) * (tape.open[:h] * np.float32(0.25))
        by_r = tape.u * (tape.open[h:] * np.float32(0.25))
        inputs, through = np.empty((3 * h, back.shape[1]), np.float32), np.empty((3 * h, back.shape[1]), np.float32)
        later = np.zeros((h, 0), np.float32)
        turned = np.ascontiguousarray(self.recur.T)
        for t in range(len(edges) - 2, -1, -1):
            lo, hi = edges[t], edges[t + 1]
            d, x, y = back[:, lo:hi], inputs[:, lo:hi], through[:, lo:hi]
            d[:, : later.shape[1]] += later
            np.multiply(d, by_new[:, lo:hi], out=x[2 * h :])
            np.multiply(d, by_z[:, lo:hi], out=x[:h])
            np.multiply(x[2 * h :], by_r[:, lo:hi], out=x[h : 2 * h])
            y[: 2 * h] = x[: 2 * h]
            np.multiply(x[2 * h :], tape.r[:, lo:hi], out=y[2 * h :])
            later = turned @ y
            d *= tape.z[:, lo:hi]
            later += d
            if fresh[lo:hi].any():
                later *= ~fresh[lo:hi]
        grads.recur += through @ tape.before.T
        return inputs.T


_ONES = np.ones(PER_CLASS, np.float32)


class Lanes(NamedTuple):
    """Documents laid end to end in lanes of similar length; a lane starts a document with state 0."""

    tokens: np.ndarray  # step, lane: token index or -1
    fresh: np.ndarray  # step, lane: whether a document begins
    widths: np.ndarray  # lanes still in use at each step; lanes are in order of length


def lanes(ptr: np.ndarray, most: int) -> Lanes:
    """Longest documents first, each to the shortest lane. There are no more lanes than the longest document leaves busy."""
    import heapq

    lengths = np.diff(ptr)
    busy = -(-int(ptr[-1] - ptr[0]) // max(1, int(lengths.max(initial=1))))
    heap = [(0, i) for i in range(max(1, min(most, len(lengths), busy)))] if len(lengths) else []
    own: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        n, i = heapq.heappop(heap)
        own[i].append(int(d))
        heapq.heappush(heap, (n + int(lengths[d]), i))
    own.sort(key=lambda x: -int(lengths[x].sum()) if x else 0)
    sizes = np.array([int(lengths[x].sum()) if x else 0 for x in own])
    steps = int(sizes[0]) if len(sizes) else 0
    tokens, fresh = np.full((steps, len(own)), -1, np.int64), np.zeros((steps, len(own)), bool)
    for i, docs in enumerate(own):
        at = 0
        for d in docs:
            n = int(lengths[d])
            tokens[at : at + n, i] = np.arange(ptr[d], ptr[d + 1])
            if n:
                fresh[at, i] = True
            at += n
    return Lanes(tokens, fresh, np.searchsorted(-sizes, -np.arange(steps), "left"))


def with_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch with an end after each document, and where documents begin."""
    parts, lengths = [], []
    for b in blocks(column):
        parts.append(np.insert(b.hashes, b.ptr[1:], END_HASH))
        lengths.append(np.diff(b.ptr) + 1)
    if not parts:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def groups(ptr: np.ndarray, tokens: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about so many tokens, at least one document each."""
    lo = 0
    while lo < len(ptr) - 1:
        hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + tokens, "right")) - 1)
        yield lo, hi
        lo = hi


def steps(plan: Lanes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window by window: tokens step after step, where steps begin and end, and which tokens begin a document."""
    for lo in range(0, len(plan.tokens), window):
        widths = plan.widths[lo : lo + window]
        used = [(plan.tokens[lo + t, :n], plan.fresh[lo + t, :n]) for t, n in enumerate(widths)]
        yield np.concatenate([x for x, _ in used]), np.concatenate([[0], np.cumsum(widths)]), np.concatenate([x for _, x in used])


def log_probabilities(net: Net, places: np.ndarray, ptr: np.ndarray, most_lanes: int = 512, window: int = 16) -> np.ndarray:
    """Natural log-probability of each token; state is carried through each document. Every document ends with the end,
    which is also what comes before the next one's first token."""
    out = np.empty(len(places))
    plan = lanes(ptr, most_lanes)
    state = np.zeros((HIDDEN, plan.tokens.shape[1]), np.float32)
    for token, edges, fresh in steps(plan, window):
        states, state, _ = net.forward(places[token - 1], edges, fresh, state)
        out[token] = net.outputs(states, places[token])[0]
    return out


def learn(vector: np.ndarray, places: np.ndarray, ptr: np.ndarray, moments: np.ndarray, rate: float, most_lanes: int = 256, least_window: int = 16, update_tokens: int = 4096) -> int:
    """Truncated backpropagation through the documents, in place; moments are Adagrad's sums. Returns tokens learned.

    A window has at least ``least_window`` steps and, with few lanes, as many as give an update its tokens.
    """
    net, second, plan = Net(vector), Net(moments), lanes(segments(ptr), most_lanes)
    window = max(least_window, min(64, update_tokens // max(1, plan.tokens.shape[1])))
    state = np.zeros((HIDDEN, plan.tokens.shape[1]), np.float32)
    total, first_dense = 0, net.inputs.size
    gradient = np.zeros_like(vector)
    grads, dense = Net(gradient), gradient[first_dense:]
    scratch = np.empty_like(dense)

    def moved(g: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return rate * g / (np.sqrt(sums) + 1e-6)

    for token, edges, fresh in steps(plan, window):
        dense[:] = 0
        rows = places[token - 1]
        states, state, tape = net.forward(rows, edges, fresh, state, keep=True)
        state = state.copy()
        _, back = net.outputs(states, places[token], grads)
        inputs = net.backward(back, edges, fresh, tape, grads)
        # the rows of "other" are added up at once, those of each word in a run of their own
        words = np.flatnonzero(rows)
        order = words[np.argsort(rows[words].astype(np.int16), kind="stable")]
        used, begin = np.unique(rows[order], return_index=True)
        g = np.add.reduceat(inputs[order], begin, axis=0) if len(used) else np.zeros((0, 3 * HIDDEN), np.float32)
        if len(words) < len(rows):
            used, g = np.append(used, OTHER), np.vstack([g, (inputs.T @ (rows == OTHER).astype(np.float32))[None]])
        g = np.clip(g / len(token), -0.5, 0.5)
        second.inputs[used] += g * g
        net.inputs[used] -= moved(g, second.inputs[used])
        dense /= len(token)
        np.clip(dense, -0.5, 0.5, out=dense)
        np.multiply(dense, dense, out=scratch)
        moments[first_dense:] += scratch
        np.sqrt(moments[first_dense:], out=scratch)
        scratch += 1e-6
        np.divide(dense, scratch, out=scratch)
        scratch *= rate
        vector[first_dense:] -= scratch
        total += len(token)
    return total


def segments(ptr: np.ndarray) -> np.ndarray:
    """Places where documents begin, and those after each SEGMENT tokens of a document."""
    lengths = np.diff(ptr)
    parts = np.maximum(-(-lengths // SEGMENT), 1)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(ptr[:-1], parts) + nth * SEGMENT, ptr[-1])


def coded(docs: DataFrame, vocab, n_shards: int) -> DataFrame:
    """shard, place, words of each training document: places in the network's vocabulary, two bytes a token. The shard and
    the place in it come from a hash of id and text, so they don't depend on how the rows are partitioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            tokens, ptr = with_ends(batch.column(1))
            places = v.places_of(tokens).astype(np.uint16).tobytes()
            words = pa.array([places[2 * a : 2 * b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["place", "words"])

    rows = docs.filter("NOT held_out").select(F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(run, "place long, words binary")
    return written(rows.withColumn("shard", F.pmod("place", F.lit(n_shards)).cast("long")), "coded")


def trained(rows: DataFrame, start: np.ndarray, rounds: int, rate: float, n_shards: int) -> np.ndarray:
    """Parameters after ``rounds`` rounds over ``coded`` rows, each over its own share of the shards, so every training
    document gives its gradient steps once. In a round all shards start from the same parameters; their results are
    averaged, weighted by tokens. Parameters meet in pieces of CHUNK numbers, first within groups of tasks, so no task
    gathers more than a few hundred of them."""
    spark = rows.sparkSession

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        mixed = np.stack([np.frombuffer(bytes(v), np.float64) for v in rows["piece"]]).sum(0)
        return pd.DataFrame({"at": [rows["at"].iloc[0]], "task": [rows["task"].iloc[0] // 256], "weight": [rows["weight"].sum()], "piece": [mixed.tobytes()]})

    vector, n_tasks = start, min(n_shards // rounds, 4 * spark.sparkContext.defaultParallelism)
    schema = "at int, task long, weight double, piece binary"
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            start = sent.value
            sums, weight = np.zeros(len(start)), 0.0

            def shards() -> Iterator[tuple[int, list[bytes]]]:
                """Documents of a shard; one with a very long document comes in parts."""
                held, last, size = [], None, 0
                for batch in batches:
                    for shard, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        if held and (shard != last or size >= 2 * SHARD_TOKENS):
                            yield last, held
                            held, size = [], 0
                        held.append(words)
                        last, size = shard, size + len(words) // 2
                if held:
                    yield last, held

            for _, parts in groupby(shards(), lambda part: part[0]):
                own, moments, tokens = start.copy(), np.full_like(start, FIRST_MOMENT), 0
                for _, held in parts:
                    ptr = np.concatenate([[0], np.cumsum([len(w) // 2 for w in held])])
                    tokens += learn(own, np.frombuffer(b"".join(held), np.uint16).astype(np.int64), ptr, moments, rate / (1 + number))
                sums += own.astype(np.float64) * tokens
                weight += tokens
            if weight:
                pieces = [sums[i : i + CHUNK].tobytes() for i in range(0, len(sums), CHUNK)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array([float(weight)] * n), pa.array(pieces, pa.binary())], names=["at", "task", "weight", "piece"])

        own_rows = rows.filter(F.pmod("shard", F.lit(rounds)) == number).repartitionByRange(n_tasks, "shard").sortWithinPartitions("shard", "place")
        summed = own_rows.select("shard", "words").mapInArrow(run, schema).groupBy("at", F.pmod("task", F.lit(64)).alias("group")).applyInPandas(mean, schema).groupBy("at").applyInPandas(mean, schema)
        parts = summed.toPandas()
        if len(parts):
            vector = np.concatenate([np.frombuffer(bytes(p), np.float64) / w for p, w in zip(*(parts.sort_values("at")[c] for c in ("piece", "weight")), strict=True)]).astype(np.float32)
    return vector


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 10, rounds: int = 2, rate: float = 0.05, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id"), hold_out))
    counts = written(word_counts(rows), "word-counts")
    vocab = vocabulary(counts)
    sent = spark.sparkContext.broadcast(vocab)
    n_shards = max(1, rounds) * max(1, round(vocab.total / shard_tokens / max(1, rounds)))
    net = spark.sparkContext.broadcast(trained(coded(rows, sent, n_shards), initial(vocab), rounds, rate, n_shards) if rounds else initial(vocab))
    train_total, distinct = vocab.total, vocab.distinct
    other_total, other_distinct = vocab.total - vocab.inside[1:].sum(), vocab.distinct - vocab.inside_distinct
    log_all, log_other = np.log10(train_total + 0.1 * (distinct + 1)), np.log10(other_total + 0.1 * (other_distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, network = sent.value, Net(net.value)
        log_counts = np.append(np.log10(v.counts + 0.1), -1.0)  # the last is what -1 finds: a count of 0
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            tokens, ptr = with_ends(batch.column(1))
            found = v.find(tokens)
            places, logs, hit = v.places_of(tokens, found), log_counts[found], found >= 0
            model = np.concatenate([log_probabilities(network, places[ptr[a] : ptr[b]], ptr[a : b + 1] - ptr[a]) for a, b in groups(ptr)] or [np.zeros(0)]) / np.log(10)
            model += np.where(places == OTHER, logs - log_other, 0.0)
            sums = [np.add.reduceat(x, ptr[:-1]) if batch.num_rows else x[:0] for x in (logs - log_all, model, hit.astype(np.int64))]
            missing = np.flatnonzero(~hit) if not v.complete else np.zeros(0, np.int64)
            owner = np.searchsorted(ptr, missing, "right") - 1
            pairs, n = np.unique(np.rec.fromarrays([owner, tokens[missing]]), return_counts=True) if len(missing) else (np.rec.fromarrays([owner, tokens[missing]]), owner)
            edges = pa.array(np.searchsorted(pairs["f0"], np.arange(batch.num_rows + 1)), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs["f1"]).view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ptr)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(edges, flat).cast(kind)], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "missing"])
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, missing array<struct<hash: long, n: long>>")
    columns = ["doc_id", held_out(F.col("doc_id"), hold_out).alias("held_out"), "n_tokens", "n_known", F.lit(train_total).cast("long").alias("train_tokens"), "base_score", "score"]
    if vocab.complete:
        return scored.select(*columns)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # numbers are kept as they are written
    wanted = scored.filter(F.size("missing") > 0).select("row", F.explode("missing").alias("m")).select("row", F.col("m.hash").alias("hash"), F.col("m.n").alias("times"))
    # a word first taken as unseen (log10 of 0.1 is -1) gets its count
    gained = wanted.join(counts, "hash").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("more"))
    both = scored.join(gained, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.withColumns({"n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "base_score": F.col("base_score") + more, "score": F.col("score") + more}).select(*columns)
