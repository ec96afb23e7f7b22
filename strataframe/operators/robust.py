"""Robust linear estimators: iteratively reweighted least squares, one aggregation a round."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from .estimate import linear, ridge
from .trials import complete


class Robust(NamedTuple):
    coefficients: list[float] | None
    rounds: int
    converged: bool

    def predict(self, features: Sequence[Column]) -> Column:
        return F.lit(None).cast("double") if self.coefficients is None else linear(features, self.coefficients)


def loss_weight(residual: Column, loss: str, scale: float) -> Column:
    """What a row's weight is multiplied by: ``absolute``: 1 / |r|, at most 1 / scale; ``huber``: 1 up to scale, then scale / |r|."""
    size = F.greatest(F.abs(residual), F.lit(scale))
    if loss == "absolute":
        return 1 / size
    if loss == "huber":
        return scale / size
    raise ValueError(f"no weights are known for the loss {loss!r}")


def robust(df: DataFrame, features: Sequence[Column], target: Column, weight: Column, *, loss: str = "absolute", scale: float = 1e-3, alpha: float = 0.0, tolerance: float = 1e-9, rounds: int = 200) -> Robust:
    """Coefficients that minimise the weighted loss of the residuals (plus ``alpha`` times the squared coefficients).

    Rows are written once, as the features, target and weight alone; each round adds up one system of p * (p + 3) / 2 sums,
    and stops when no coefficient moves by more than ``tolerance`` of its size (or of 1). ``converged`` says if it did within
    ``rounds``. Rows of which a value isn't finite are left out; without rows, or with features that say the same, there are
    no coefficients.
    """
    p = len(features)
    thin = complete(df, [*features, target, weight]).select(*(f.cast("double").alias(f"x{i}") for i, f in enumerate(features)), target.cast("double").alias("y"), weight.cast("double").alias("w"))
    rows = written(thin.filter("w > 0"), "robust")
    x, y, w = [F.col(f"x{i}") for i in range(p)], F.col("y"), F.col("w")

    def solve(factor: Column) -> np.ndarray | None:
        try:
            found = ridge(rows, x, y, w * factor, alpha)
        except np.linalg.LinAlgError:
            return None
        return found if np.isfinite(found).all() else None

    now = solve(F.lit(1.0))
    for k in range(1, rounds + 1):
        if now is None:
            return Robust(None, k - 1, False)
        after = solve(loss_weight(y - linear(x, now), loss, scale))
        if after is None:
            return Robust(None, k, False)
        moved = np.abs(after - now) <= tolerance * np.maximum(1.0, np.abs(after))
        now = after
        if moved.all():
            return Robust([float(c) for c in now], k, True)
    return Robust([float(c) for c in now], rounds, False)
