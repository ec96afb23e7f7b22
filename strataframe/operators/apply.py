"""A model that lives in Python, told to all tasks once and applied batch by batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError

#: Bytes that a broadcast model may have.
MOST_BYTES = 256 << 20


class Model(Protocol):
    def predict(self, frame: pd.DataFrame) -> np.ndarray: ...


class ByGroup(NamedTuple):
    """Linear coefficients for each group; a row of an unknown group has no prediction."""

    group: str
    features: list[str]
    coefficients: dict[object, list[float]]

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        none = [float("nan")] * len(self.features)
        chosen = np.array([self.coefficients.get(g) or none for g in frame[self.group]], float).reshape(len(frame), len(self.features))
        return (chosen * frame[self.features].to_numpy(float)).sum(axis=1)


def predictions(df: DataFrame, model: Model, inputs: Sequence[str], keep: Sequence[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns ``keep`` and ``prediction`` (null where the model gives no finite number). The model sees the columns
    ``inputs`` of an Arrow batch at a time. One that is larger than ``most_bytes`` is refused before it is sent anywhere."""
    size = len(pickle.dumps(model))
    if size > most_bytes:
        raise ContractError(f"the model has {size} bytes; at most {most_bytes} are told to all tasks")
    missing = [c for c in (*inputs, *keep) if c not in df.columns]
    if missing:
        raise ContractError(f"the model needs {missing}")
    sent, inputs, keep = df.sparkSession.sparkContext.broadcast(model), list(inputs), list(keep)
    columns = list(dict.fromkeys([*keep, *inputs]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.asarray(sent.value.predict(frame[inputs]), float) if len(frame) else np.zeros(0)
            if found.shape != (len(frame),):
                raise ValueError("a model gives one number for each row")
            yield frame[keep].assign(prediction=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keep).schema) + ", prediction double"
    out = df.select(columns).mapInPandas(run, schema)
    value = F.col("prediction")
    return out.withColumn("prediction", F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value))
