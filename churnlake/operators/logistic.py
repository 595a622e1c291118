"""Logistic regression by iteratively reweighted least squares, several fits at once.

A Newton step needs the gradient and the weighted second moments of the
features: tasks add them up in matrix products, one grouped sum joins the
parts, and the driver solves one small system per fit. So a step is one pass
over the rows for all fits. The penalty is half the squared coefficients
(C = 1) without the intercept, which comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 25, 1e-10


def _design(batch) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(beta: dict[int, np.ndarray]):
    """Batches of (fit, label, x) -> (fit, cell, value): gradient, then the rows of the second moments."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            fits, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _design(b)
            for f in np.unique(fits).tolist():
                part, own = x[fits == f], y[fits == f]
                p = 1 / (1 + np.exp(-(part @ beta[f])))
                cells = np.concatenate([part.T @ (own - p), ((part * (p * (1 - p))[:, None]).T @ part).ravel()])
                total[f] = total.get(f, 0) + cells
        for f, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), f, np.int32)), pa.array(np.arange(len(cells))),
                                              pa.array(cells)], ["fit", "cell", "value"])
    return run


def fit_logistic(vectors: DataFrame, fits: list[int], width: int, penalty: float = 1.0) -> dict[int, np.ndarray]:
    """Coefficients (features, then intercept) of each fit from its training rows (fit, train, label, x)."""
    rows = vectors.where("train").select(F.col("fit").cast("int"), F.col("label").cast("double").alias("label"), "x")
    beta = {f: np.zeros(width + 1) for f in fits}
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 0.0
    moving = set(fits)
    for _ in range(STEPS):
        sums = rows.where(F.col("fit").isin(*moving)).mapInArrow(_sums(beta), "fit int, cell long, value double") \
            .groupBy("fit", "cell").agg(F.sum("value").alias("value")).toArrow()
        of, cell, value = (sums.column(c).to_numpy() for c in ("fit", "cell", "value"))
        for f in sorted(moving):
            flat = np.zeros((width + 1) * (width + 2))
            flat[cell[of == f]] = value[of == f]
            grad, second = flat[: width + 1] - ridge * beta[f], flat[width + 1:].reshape(width + 1, -1)
            step = np.linalg.solve(second + np.diag(np.maximum(ridge, 1e-12)), grad)
            beta[f] = beta[f] + step
            if np.abs(step).max() < TOLERANCE:
                moving.discard(f)
        if not moving:
            break
    return beta


def predict_logistic(beta: dict[int, np.ndarray], vectors: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and score, natively: the linear term is one expression over the vector."""
    z = None
    for f, b in beta.items():
        weights = F.array(*[F.lit(float(v)) for v in b[:-1]])
        term = F.aggregate(F.zip_with("x", weights, lambda a, w: a * w), F.lit(float(b[-1])), lambda s, v: s + v)
        z = F.when(F.col("fit") == f, term) if z is None else z.when(F.col("fit") == f, term)
    return vectors.select(*keep, (1 / (1 + F.exp(-z))).alias("score"))
