"""Exact digests of sorted values, whatever the size of a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a piece of text at most.
PIECE = 4_096


def ordered_digest(df: DataFrame, group: Sequence[str], value: str, separator: str = ",", piece: int = PIECE) -> DataFrame:
    """group, sha256 of the group's values in order, as text, joined by the separator; nulls are left out, and a group without
    another value has the empty text's hash.

    Values are sorted by range over all groups, so a large group is spread over many tasks, and joined there to pieces of text;
    only the pieces of a group come together, one after another, in the task that hashes them. A value's order is that of its
    column's type.
    """
    keys = [f"__k{i}" for i in range(len(group))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col(value).alias("__v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    width = len(keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = list(zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True)) if width else [()] * batch.num_rows
            values = batch.column(width).cast(pa.string()).to_pylist()
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1] or not i % piece), len(of)]
            spans = [(a, b) for a, b in pairwise(cuts) if b > a]
            texts = [[v for v in values[a:b] if v is not None] for a, b in spans]
            first = pa.array([a for a, _ in spans], pa.int64())
            joined = [pa.array([separator.join(t) for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.take(first) for c in batch.columns), *joined], names=[*keys, "__v", "__text", "__n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun, last = None, None, False, None

        def result(done: list[tuple[pa.RecordBatch, str]]) -> pa.RecordBatch | None:
            if not done:
                return None
            columns = [pa.concat_arrays([row.column(k) for row, _ in done]) for k in range(width)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([h for _, h in done], pa.string())], names=[*keys, "sha256"])

        for batch in batches:
            done = []
            of = list(zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True)) if width else [()] * batch.num_rows
            for i, (key, text, n) in enumerate(zip(of, batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True)):
                if state is None or key != at:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    at, state, begun, last = key, hashlib.sha256(), False, batch.slice(i, 1)
                if n:
                    state.update((separator + text if begun else text).encode())
                    begun = True
            if (out := result(done)) is not None:
                yield out
        if state is not None:
            yield result([(last, state.hexdigest())])

    order = [*(F.asc_nulls_first(k) for k in keys), F.asc_nulls_first("__v")]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{kinds}, __text string, __n long")
    placed = (pieces.repartition(*keys) if keys else pieces.coalesce(1)).sortWithinPartitions(*order)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), "sha256 string"])
    return placed.mapInArrow(hashed, schema).select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=True)), "sha256")
