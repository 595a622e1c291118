"""Whole-portfolio batch scoring (stateless per row, no shuffle).

``mart -> scorer -> probability -> band / prediction -> constants``. The
instant is taken once on the driver and passed in as a literal so every row
of a batch agrees and a re-run with the same instant is reproducible.
"""

from __future__ import annotations

import datetime as _dt
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import fixed_score, risk_band, threshold_predict
from churnlake.schemas import (CLASSIFICATION_THRESHOLD, MODEL_ALIAS, MODEL_NAME,
                               MODEL_VERSION, PREDICTION_COLUMNS, WATCHLIST_THRESHOLD)

Scorer = Callable[[DataFrame], DataFrame]


def fixed_scorer(mart: DataFrame) -> DataFrame:
    """customer_id + churn_probability from the SQL-expressible scorer."""
    return mart.select("customer_id", fixed_score().alias("churn_probability"))


def model_scorer(model) -> Scorer:
    """Adapter for a fitted Spark ML ``PipelineModel`` with a probability column."""
    from pyspark.ml.functions import vector_to_array

    def score(mart: DataFrame) -> DataFrame:
        out = model.transform(mart)
        return out.select("customer_id",
                          vector_to_array("probability")[1].alias("churn_probability"))
    return score


def utc_now_literal() -> str:
    """Driver-side UTC instant, seconds precision, as text for a literal."""
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def score_portfolio(mart: DataFrame, scorer: Scorer = fixed_scorer, *,
                    watchlist: float = WATCHLIST_THRESHOLD,
                    classification: float = CLASSIFICATION_THRESHOLD,
                    scored_at: str | None = None,
                    model_name: str = MODEL_NAME,
                    model_version: int = MODEL_VERSION,
                    model_alias: str = MODEL_ALIAS) -> DataFrame:
    """The 8-column prediction frame (``PREDICTION_COLUMNS``)."""
    if not (0.0 < watchlist < classification < 1.0):
        raise ValueError("thresholds must satisfy 0 < watchlist < classification < 1")
    instant = scored_at or utc_now_literal()
    p = F.col("churn_probability")
    return scorer(mart).select(
        "customer_id",
        p.alias("churn_probability"),
        risk_band(p, watchlist, classification).alias("risk_band"),
        threshold_predict(p, classification).alias("churn_prediction"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).cast("int").alias("model_version"),
        F.lit(model_alias).alias("model_alias"),
        F.lit(instant).cast("timestamp").alias("scored_at"),
    ).select(*PREDICTION_COLUMNS)


def scoring_check_frame(mart: DataFrame, scorer: Scorer = fixed_scorer, *,
                        watchlist: float = WATCHLIST_THRESHOLD,
                        classification: float = CLASSIFICATION_THRESHOLD,
                        default_threshold: float = 0.5,
                        model_version: int = MODEL_VERSION,
                        model_alias: str = MODEL_ALIAS) -> DataFrame:
    """The validation frame: keeps the actual label and the model's own
    0.5-cut prediction next to the official one."""
    scored = scorer(mart).join(mart.select("customer_id", "churn_flag"), "customer_id")
    p = F.col("churn_probability")
    return scored.select(
        "customer_id",
        F.col("churn_flag").alias("actual_churn_flag"),
        p.alias("churn_probability"),
        risk_band(p, watchlist, classification).alias("risk_band"),
        threshold_predict(p, classification).alias("official_prediction"),
        threshold_predict(p, default_threshold).alias("default_prediction"),
        F.lit(model_version).cast("int").alias("model_version"),
        F.lit(model_alias).alias("model_alias"),
    )
