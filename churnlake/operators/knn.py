"""k-nearest neighbours with distance weights over a bounded fit set.

The model is at most ``max_fit_rows`` labelled rows (those with the smallest
hash of their id, so the choice does not depend on order or cluster size):
that parameter bounds the model, like the number of trees bounds a forest.
Medians, modes, means and deviations come from all training rows. Scoring is
local to each row: the model travels with the task, no pair of rows is ever
joined or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import hash_unit
from churnlake.operators import features as FT
from churnlake.operators.prefix import materialize
from churnlake.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

NEIGHBOURS = 25
MAX_FIT_ROWS = 5_000
_ROWS_AT_ONCE = 64


def _prepared(model: dict, df: DataFrame, label: str) -> DataFrame:
    imputed = FT.apply_imputer(df.select("customer_id", F.col(label).cast("double").alias("label"),
                                         *NUMERIC_FEATURES, *CATEGORICAL_FEATURES), model["imputer"])
    return FT.apply_scaler(imputed, model["scaler"])


def fit(train: DataFrame, label: str = "churn_flag", max_fit_rows: int = MAX_FIT_ROWS) -> dict:
    """Preparation from all labelled training rows, and the bounded fit set."""
    rows = materialize(train.select("customer_id", label, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)
                       .filter(F.col(label).isNotNull()))
    imputer = FT.fit_imputer(rows, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    scaler = FT.fit_scaler(FT.apply_imputer(rows.select(*NUMERIC_FEATURES), imputer), NUMERIC_FEATURES)
    model = {"imputer": imputer, "scaler": scaler}
    kept = rows.orderBy(hash_unit("knn:", "customer_id"), "customer_id").limit(max_fit_rows)
    pdf = _prepared(model, kept, label).toPandas().sort_values("customer_id")
    known = FT.long_values(FT.apply_imputer(rows.select(*CATEGORICAL_FEATURES), imputer), CATEGORICAL_FEATURES,
                           "string").distinct()
    return model | {"rows": pdf, "known": known}


def nearest_scores(fit_num: np.ndarray, fit_cat: np.ndarray, fit_y: np.ndarray, num: np.ndarray, cat: np.ndarray,
                   known: np.ndarray, k: int) -> np.ndarray:
    """P(label 1) per row: labels of the k nearest weighted by 1 / distance; exact matches take all weight.

    Categories count as indicators: unequal ones differ in the fit row's
    indicator, and in the row's own if that category was seen in training.
    Squared distances are compared to 9 decimals, ties go to the smaller id.
    """
    out = np.empty(len(num))
    for at in range(0, len(num), _ROWS_AT_ONCE):
        a = num[at: at + _ROWS_AT_ONCE]
        d2 = np.square(a[:, None, :] - fit_num[None]).sum(axis=2)
        differs = cat[at: at + _ROWS_AT_ONCE, None, :] != fit_cat[None]
        d2 += (differs * (1 + known[at: at + _ROWS_AT_ONCE])[:, None, :]).sum(axis=2)
        d2 = np.round(d2, 9)
        order = np.argsort(d2, axis=1, kind="stable")[:, :k]
        d = np.sqrt(np.take_along_axis(d2, order, axis=1))
        exact = d == 0
        weight = np.where(exact.any(axis=1, keepdims=True), exact, 1 / np.where(exact, 1, d))
        out[at: at + _ROWS_AT_ONCE] = (weight * fit_y[order]).sum(axis=1) / weight.sum(axis=1)
    return out


def predict(model: dict, df: DataFrame, label: str = "churn_flag", k: int = NEIGHBOURS) -> DataFrame:
    """customer_id, label, score = P(label 1), prediction = score > 0.5 (ties -> 0).

    Without any fit row the score is NULL."""
    rows = model["rows"]
    fit_num = rows[NUMERIC_FEATURES].to_numpy(float)
    fit_cat = rows[CATEGORICAL_FEATURES].to_numpy(str)
    fit_y = rows["label"].to_numpy(float)
    prepared = _prepared(model, df, label)
    for c in CATEGORICAL_FEATURES:  # whether training saw the category: a join that Spark sizes
        seen = model["known"].filter(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.lit(1.0).alias(f"_known_{c}"))
        prepared = prepared.join(seen, F.col(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(fit_y) and len(b):
                s = nearest_scores(fit_num, fit_cat, fit_y, b[NUMERIC_FEATURES].to_numpy(float),
                                   b[CATEGORICAL_FEATURES].to_numpy(str),
                                   b[[f"_known_{c}" for c in CATEGORICAL_FEATURES]].fillna(0).to_numpy(float), k)
            else:
                s = np.full(len(b), np.nan)
            yield pd.DataFrame({"customer_id": b["customer_id"], "label": b["label"], "score": s})

    scored = prepared.mapInPandas(score, "customer_id long, label double, score double")
    p = F.nanvl("score", F.lit(None).cast("double"))
    return scored.select("customer_id", F.col("label").cast("int").alias("label"), p.alias("score"),
                         (p > 0.5).cast("int").alias("prediction"))
