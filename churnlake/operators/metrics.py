"""Classification metrics as DataFrame jobs (exact, grouped, no UDFs).

All ranking metrics start from one row per (group, distinct score) with
``n`` rows and ``tp`` positives, then use distributed running sums
(``prefix.running_sums``) in descending score order:

* precision/recall/F1 at every distinct score (the PR curve);
* average precision = sum over scores of (tp / P) * precision
  (step-wise, no interpolation: not Spark's trapezoidal areaUnderPR);
* ROC AUC with ties = sum neg * (positives above + tp / 2) / (P * N).

Threshold metrics come from one conditional aggregation per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import f1_from, safe_div
from churnlake.operators.prefix import running_sums


def score_bounds(df: DataFrame, score: str = "score", buckets: int | None = None) -> list[float]:
    """Bucket boundaries of a score column, computed once and shared by
    every grouped metric job over the same score domain (splits, folds,
    thresholds): one quantile pass instead of one per job."""
    from churnlake.operators.prefix import bucket_boundaries, default_buckets
    return bucket_boundaries(df, score, buckets or default_buckets(df))


def score_groups(df: DataFrame, label: str = "label", score: str = "score", group_cols=()) -> DataFrame:
    return (df.groupBy(*group_cols, F.col(score).alias("threshold"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(F.col(label).cast("bigint")).alias("tp")))


def _grouped(df: DataFrame, group_cols):
    """Metrics always run grouped; without groups a constant key ``_g`` keeps
    every join an equi-join on a bounded table (no nested subqueries)."""
    group_cols = list(group_cols)
    if group_cols:
        return df, group_cols, False
    return df.withColumn("_g", F.lit(0)), ["_g"], True


def pr_table(df: DataFrame, label: str = "label", score: str = "score", group_cols=(),
             buckets: int | None = None, bounds: list[float] | None = None) -> DataFrame:
    """One row per (group, distinct score): counts at and above the score,
    precision, recall and F1 (NULL when precision + recall = 0)."""
    df, gcols, synthetic = _grouped(df, group_cols)
    g = score_groups(df, label, score, gcols)
    j = (running_sums(g, "threshold", ["n", "tp"], gcols, descending=True, buckets=buckets, bounds=bounds,
                      with_totals=True)
         .withColumnRenamed("total_tp", "positives").withColumnRenamed("total_n", "total"))
    precision = F.col("cum_tp") / F.col("cum_n")
    recall = safe_div("cum_tp", "positives")
    out_groups = [] if synthetic else gcols
    return j.select(*out_groups, "threshold", "n", "tp", "cum_n", "cum_tp", "positives", "total",
                    precision.alias("precision"), recall.alias("recall"),
                    f1_from(precision, recall).alias("f1"))


def ranking_metrics(pr: DataFrame, group_cols=()) -> DataFrame:
    """ROC AUC and average precision per group from ``pr_table``."""
    neg = F.col("n") - F.col("tp")
    above = F.col("cum_tp") - F.col("tp")
    auc_term = neg * (above + F.col("tp") / F.lit(2.0))
    # undefined (NULL) when a group has no positives or no negatives
    ap_term = F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")
    pairs = F.first("positives") * (F.first("total") - F.first("positives"))
    return pr.groupBy(*group_cols).agg(
        (F.sum(auc_term) / F.nullif(pairs, F.lit(0))).alias("roc_auc"),
        F.sum(ap_term).alias("average_precision"))


def confusion_counts(df: DataFrame, threshold, label: str = "label", score: str = "score",
                     group_cols=()) -> DataFrame:
    """tp/fp/tn/fn at an inclusive threshold (a float or a Column)."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return df.groupBy(*group_cols).agg(
        F.count_if(pred & y).cast("bigint").alias("tp"),
        F.count_if(pred & ~y).cast("bigint").alias("fp"),
        F.count_if(~pred & ~y).cast("bigint").alias("tn"),
        F.count_if(~pred & y).cast("bigint").alias("fn"))


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 from confusion
    counts; zero division gives 0 like the reference's metric calls."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    recall = safe_div(tp, tp + fn, 0.0)
    specificity = safe_div(tn, tn + fp, 0.0)
    return counts.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "tn", "fn")], "tp", "fp", "tn", "fn",
        safe_div(tp + tn, n, 0.0).alias("accuracy"),
        ((recall + specificity) / F.lit(2.0)).alias("balanced_accuracy"),
        safe_div(tp, tp + fp, 0.0).alias("precision"),
        recall.alias("recall"),
        safe_div(F.lit(2) * tp, F.lit(2) * tp + fp + fn, 0.0).alias("f1"))


def evaluate_predictions(df: DataFrame, threshold=0.5, label: str = "label", score: str = "score",
                         group_cols=(), model: str | None = None,
                         bounds: list[float] | None = None) -> DataFrame:
    """The 9-field metric row (model, threshold, roc_auc, average_precision,
    accuracy, balanced_accuracy, precision, recall, f1) per group.

    One aggregation over the per-score table gives both the ranking metrics
    and the confusion counts at the threshold (rows at or above it are
    predicted positive), so the raw rows are grouped once and nothing is
    joined. Labels must be 0/1."""
    df, gcols, synthetic = _grouped(df, group_cols)
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    pr = pr_table(df, label, score, gcols, bounds=bounds)
    neg = F.col("n") - F.col("tp")
    above = F.col("threshold") >= t
    below = F.col("threshold") < t
    zero = F.lit(0).cast("bigint")
    summed = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), zero).cast("bigint")
    counts = pr.groupBy(*gcols).agg(
        (F.sum(neg * ((F.col("cum_tp") - F.col("tp")) + F.col("tp") / F.lit(2.0)))
         / F.nullif(F.first("positives") * (F.first("total") - F.first("positives")), F.lit(0))).alias("roc_auc"),
        F.sum(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")).alias("average_precision"),
        summed(above, F.col("tp")).alias("tp"), summed(above, neg).alias("fp"),
        summed(below, neg).alias("tn"), summed(below, F.col("tp")).alias("fn"))
    j = threshold_metrics(counts)
    head = [F.lit(model).alias("model")] if model is not None else []
    out_groups = [] if synthetic else gcols
    return j.select(*head, *out_groups, t.cast("double").alias("threshold"), "roc_auc",
                    "average_precision", "accuracy", "balanced_accuracy", "precision", "recall", "f1")


def evaluate_at_thresholds(df: DataFrame, thresholds: dict, model: str, label: str = "label", score: str = "score",
                           bounds: list[float] | None = None) -> DataFrame:
    """(model, threshold_name, threshold, the seven metrics) for several named
    thresholds (floats or Columns) from one ranking and one aggregation."""
    cut = {k: t if not isinstance(t, (int, float)) else F.lit(float(t)) for k, t in thresholds.items()}
    pr = pr_table(df, label, score, bounds=bounds)
    neg = F.col("n") - F.col("tp")
    zero = F.lit(0).cast("bigint")
    summed = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), zero).cast("bigint")
    above = F.col("threshold")
    one = pr.agg(
        (F.sum(neg * ((F.col("cum_tp") - F.col("tp")) + F.col("tp") / F.lit(2.0)))
         / F.nullif(F.first("positives") * (F.first("total") - F.first("positives")), F.lit(0))).alias("roc_auc"),
        F.sum(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")).alias("average_precision"),
        *[F.struct(summed(above >= t, F.col("tp")).alias("tp"), summed(above >= t, neg).alias("fp"),
                   summed(above < t, neg).alias("tn"), summed(above < t, F.col("tp")).alias("fn")).alias(f"c_{k}")
          for k, t in cut.items()])
    rows = one.select("roc_auc", "average_precision", F.explode(F.array(*[
        F.struct(F.lit(k).alias("threshold_name"), t.cast("double").alias("threshold"), F.col(f"c_{k}").alias("c"))
        for k, t in cut.items()])).alias("r")).select(
        F.lit(model).alias("model"), "r.threshold_name", "r.threshold", "roc_auc", "average_precision", "r.c.*")
    return threshold_metrics(rows).drop("tp", "fp", "tn", "fn")


def best_f1_threshold(pr: DataFrame, group_cols=()) -> DataFrame:
    """Argmax F1 over the curve (rows with undefined F1 dropped); ties go to
    the highest threshold."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.col("f1"), F.col("threshold")))
    return (pr.filter(F.col("f1").isNotNull()).groupBy(*group_cols).agg(best.alias("b"))
            .select(*group_cols, "b.*"))


def watchlist_threshold(pr: DataFrame, min_precision: float = 0.80, group_cols=()) -> DataFrame:
    """Highest recall (then F1, then threshold) among thresholds whose
    precision reaches the floor; empty when none does."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.col("recall"), F.col("f1"), F.col("threshold")))
    return (pr.filter(F.col("f1").isNotNull() & (F.col("precision") >= F.lit(min_precision)))
            .groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, "b.*"))


def confusion_matrix(df: DataFrame, threshold, label: str = "label", score: str = "score") -> DataFrame:
    """2x2 (actual, predicted, customers), zero-filled: the four cells come
    from one conditional aggregation, so an empty cell is a 0 not a gap."""
    c = confusion_counts(df, threshold, label, score)
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("customers")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("customers")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("customers")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("customers")),
    )).alias("c")).select("c.*")
