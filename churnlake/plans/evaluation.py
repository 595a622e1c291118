"""Model evaluation reports built from grouped metric jobs.

Each report is a handful of grouped aggregations over a scored frame
``(customer_id, label, score, <group cols>)``: per-group metrics are one
job for all groups (splits, folds, models), never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.operators import metrics as M

METRICS = ["roc_auc", "average_precision", "accuracy", "balanced_accuracy", "precision", "recall", "f1"]


def overfit_table(scored: DataFrame, model: str, threshold: float = 0.5, bounds=None) -> DataFrame:
    """Train vs validation AUC / AP / F1 and their gaps (train - validation)."""
    per = M.evaluate_predictions(scored, threshold, group_cols=["split"], bounds=bounds)
    pick = lambda m, s: F.max(F.when(F.col("split") == s, F.col(m)))
    aggs = []
    for m in ("roc_auc", "average_precision", "f1"):
        aggs += [pick(m, "train").alias(f"train_{m}"), pick(m, "validation").alias(f"validation_{m}"),
                 (pick(m, "train") - pick(m, "validation")).alias(f"{m}_gap")]
    return per.agg(*aggs).select(F.lit(model).alias("model"), "*")


def cv_summary(scored_folds: DataFrame, model_col: str = "model", fold_col: str = "fold",
               threshold: float = 0.5, bounds=None) -> DataFrame:
    """Mean and population std of fold metrics per model."""
    per = M.evaluate_predictions(scored_folds, threshold, group_cols=[model_col, fold_col], bounds=bounds)
    aggs = []
    for m in ("roc_auc", "average_precision", "f1"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per.groupBy(model_col).agg(F.count(F.lit(1)).cast("bigint").alias("folds"), *aggs)


def final_test_report(test: DataFrame, thresholds: dict, model: str, bounds=None) -> DataFrame:
    """Metric rows on the test split at each named threshold (Columns or
    floats, e.g. scalar subqueries of the validation thresholds): the split
    is ranked once and counted once for all thresholds."""
    return M.evaluate_at_thresholds(test, thresholds, model, bounds=bounds).select(
        "model", "threshold_name", "threshold", *METRICS)


def metrics_long(report: DataFrame, id_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Wide metric columns -> (id..., metric, value) rows."""
    return report.unpivot(id_cols, value_cols, "metric", "value")


def rank_models(report: DataFrame) -> DataFrame:
    """1..n by average precision desc, ROC AUC desc, model name asc.

    The report holds one row per model (a dozen at most), so a single
    ordered window over it is bounded."""
    w = Window.orderBy(F.col("average_precision").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(),
                       F.col("model").asc())
    return report.withColumn("ranking", F.row_number().over(w))
