"""Metric, threshold, split and cross-validation queries.

Scores come from ``labelled_scores`` (an informative, tie-heavy integer
score derived from the mart) because the fixed scorer carries no signal on
the synthetic tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import metrics as M
from churnlake.operators import splits as S
from churnlake.oracle import CHAIN, LABELLED, SPLIT, sql
from churnlake.queries.common import mart_df
from churnlake.registry import register, round_doubles
from churnlake.schemas import WATCHLIST_MIN_PRECISION


def labelled(spark, sf):
    return S.labelled_scores(mart_df(spark, sf))


def labelled_pr(spark, sf):
    """(labelled frame, its PR table). The input is a cheap scan of the mart
    table, so the bucket boundaries come straight from its score column (one
    quantile pass) instead of materialising the per-score table first."""
    lab = labelled(spark, sf)
    return lab, M.pr_table(lab, bounds=M.score_bounds(lab))


def labelled_split(spark, sf):
    """(customer_id, label, score, split): narrow, written once because
    split-wise reports read it several times."""
    from churnlake.operators.prefix import materialize
    m = mart_df(spark, sf).select("customer_id", "churn_flag")
    return materialize(S.hash_split(S.labelled_scores(m)))


# --- SQL building blocks ---------------------------------------------------

def _pr_cte(src: str = "labelled", group: str | None = None, name: str = "pr") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
{name}_g AS (SELECT {g}score AS threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS tp FROM {src} GROUP BY {g}score),
{name} AS (
  SELECT {g}threshold, n, tp,
    CAST(sum(n) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS cum_n,
    CAST(sum(tp) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS cum_tp,
    CAST(sum(tp) OVER ({part[:-1] if part else ''}) AS BIGINT) AS positives,
    CAST(sum(n) OVER ({part[:-1] if part else ''}) AS BIGINT) AS total,
    CAST(sum(tp) OVER ({part}ORDER BY threshold DESC) AS DOUBLE) / CAST(sum(n) OVER ({part}ORDER BY threshold DESC) AS DOUBLE) AS precision,
    CAST(sum(tp) OVER ({part}ORDER BY threshold DESC) AS DOUBLE) / nullif(CAST(sum(tp) OVER ({part[:-1] if part else ''}) AS DOUBLE), 0) AS recall
  FROM {name}_g),
{name}_f AS (SELECT *, 2.0 * precision * recall / nullif(precision + recall, 0.0) AS f1 FROM {name})"""


def _rank_cte(pr: str = "pr", group: str | None = None, name: str = "rk") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""
{name} AS (
  SELECT {g}sum((n - tp) * ((cum_tp - tp) + tp / 2.0)) / nullif(max(positives) * (max(total) - max(positives)), 0) AS roc_auc,
    sum(CAST(tp AS DOUBLE) / nullif(positives, 0) * precision) AS average_precision
  FROM {pr}{gb})"""


def _conf_cte(src: str, threshold: str, group: str | None = None, name: str = "cf") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""
{name} AS (
  SELECT {g}CAST(count(*) FILTER (WHERE score >= {threshold} AND label = 1) AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE score >= {threshold} AND NOT (label = 1)) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE NOT (score >= {threshold}) AND NOT (label = 1)) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE NOT (score >= {threshold}) AND label = 1) AS BIGINT) AS fn
  FROM {src}{gb}),
{name}_m AS (
  SELECT *, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0.0) AS accuracy,
    (coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0)) / 2.0 AS balanced_accuracy,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1
  FROM {name})"""


_METRIC_COLS = "round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"

_BEST_F1 = """
best AS (SELECT threshold, precision, recall, f1 FROM pr_f WHERE f1 IS NOT NULL
         ORDER BY f1 DESC, threshold DESC LIMIT 1)"""
_WATCH = f"""
watch AS (SELECT threshold, precision, recall, f1 FROM pr_f WHERE f1 IS NOT NULL AND precision >= {WATCHLIST_MIN_PRECISION}
          ORDER BY recall DESC, f1 DESC, threshold DESC LIMIT 1)"""


# --- curve, ranking metrics, thresholds ------------------------------------

@register("pr_curve", sql(*CHAIN, LABELLED, _pr_cte(), body="""
SELECT threshold, n, tp, cum_n, cum_tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM pr_f"""))
def pr_curve(spark, sf):
    _, pr = labelled_pr(spark, sf)
    return round_doubles(pr.select("threshold", "n", "tp", "cum_n", "cum_tp", "precision", "recall", "f1"))


@register("metric_average_precision", sql(*CHAIN, LABELLED, _pr_cte(), _rank_cte("pr_f"), body="""
SELECT round(average_precision, 6) AS average_precision FROM rk"""))
def metric_average_precision(spark, sf):
    return round_doubles(M.ranking_metrics(labelled_pr(spark, sf)[1]).select("average_precision"))


@register("metric_roc_auc", sql(*CHAIN, LABELLED, _pr_cte(), _rank_cte("pr_f"), body="""
SELECT round(roc_auc, 6) AS roc_auc FROM rk"""))
def metric_roc_auc(spark, sf):
    return round_doubles(M.ranking_metrics(labelled_pr(spark, sf)[1]).select("roc_auc"))


@register("threshold_best_f1", sql(*CHAIN, LABELLED, _pr_cte(), _BEST_F1, body="""
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM best"""))
def threshold_best_f1(spark, sf):
    return round_doubles(M.best_f1_threshold(labelled_pr(spark, sf)[1]))


@register("threshold_watchlist", sql(*CHAIN, LABELLED, _pr_cte(), _WATCH, body="""
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM watch"""))
def threshold_watchlist(spark, sf):
    return round_doubles(M.watchlist_threshold(labelled_pr(spark, sf)[1], WATCHLIST_MIN_PRECISION))


@register("threshold_plot_points", sql(*CHAIN, LABELLED, _pr_cte(), body="""
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM pr_f WHERE threshold BETWEEN 0.05 AND 0.95"""))
def threshold_plot_points(spark, sf):
    pr = labelled_pr(spark, sf)[1].filter(F.col("threshold").between(0.05, 0.95))
    return round_doubles(pr.select("threshold", "precision", "recall", "f1"))


@register("evaluate_predictions", sql(*CHAIN, LABELLED, _pr_cte(), _rank_cte("pr_f"), _conf_cte("labelled", "0.5"), body=f"""
SELECT 'labelled_scores' AS model, 0.5::DOUBLE AS threshold, {_METRIC_COLS} FROM rk, cf_m"""))
def evaluate_predictions(spark, sf):
    lab = labelled(spark, sf)
    return round_doubles(M.evaluate_predictions(lab, 0.5, model="labelled_scores", bounds=M.score_bounds(lab)))


@register("confusion_matrix", sql(*CHAIN, LABELLED, _pr_cte(), _BEST_F1, body="""
SELECT a.actual, a.predicted, CAST(count(l.label) AS BIGINT) AS customers
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted)
LEFT JOIN (SELECT label, CAST(score >= (SELECT threshold FROM best) AS INTEGER) AS pred FROM labelled) l
  ON l.label = a.actual AND l.pred = a.predicted
GROUP BY a.actual, a.predicted"""))
def confusion_matrix(spark, sf):
    lab, pr = labelled_pr(spark, sf)
    t = M.best_f1_threshold(pr).select("threshold").scalar()
    return M.confusion_matrix(lab, t)


# --- splits ----------------------------------------------------------------

_EXACT = """
ex AS (
  SELECT customer_id, churn_flag,
    row_number() OVER (PARTITION BY churn_flag ORDER BY
      CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT), customer_id) AS position,
    count(*) OVER (PARTITION BY churn_flag) AS label_rows
  FROM mart)"""
#: The exact stratified split as the table ``split`` (mart columns and split).
EXACT_SPLIT = _EXACT + """,
es AS (SELECT customer_id, CASE WHEN position <= ceil(label_rows * 0.2) THEN 'test'
  WHEN position <= ceil(label_rows * 0.4) THEN 'validation' ELSE 'train' END AS split FROM ex),
split AS (SELECT m.*, es.split FROM mart m JOIN es ON es.customer_id = m.customer_id)"""


def exact_split(spark, sf):
    """The mart with ``split`` by exact quotas within each label."""
    return S.exact_stratified_split(mart_df(spark, sf)).drop("position")


@register("stratified_split", sql(*CHAIN, EXACT_SPLIT, body="SELECT customer_id, churn_flag, split FROM split"))
def stratified_split(spark, sf):
    return exact_split(spark, sf).select("customer_id", "churn_flag", "split")


@register("split_summary", sql(*CHAIN, EXACT_SPLIT, body="""
SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(churn_flag) AS BIGINT) AS churners,
  round(avg(churn_flag), 6) AS churn_rate FROM split GROUP BY split
UNION ALL
SELECT 'development', CAST(count(*) AS BIGINT), CAST(sum(churn_flag) AS BIGINT), round(avg(churn_flag), 6)
FROM split WHERE split IN ('train', 'validation')"""))
def split_summary(spark, sf):
    from churnlake.operators.prefix import materialize
    s = materialize(exact_split(spark, sf).select("split", "churn_flag"))
    agg = [F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum("churn_flag").cast("bigint").alias("churners"),
           F.avg("churn_flag").alias("churn_rate")]
    per = s.groupBy("split").agg(*agg)
    dev = s.filter(F.col("split").isin("train", "validation")).agg(*agg).select(
        F.lit("development").alias("split"), "rows", "churners", "churn_rate")
    return round_doubles(per.unionByName(dev))


_KFOLD = """
kf AS (
  SELECT customer_id, churn_flag,
    CAST((row_number() OVER (PARTITION BY churn_flag ORDER BY
      CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT), customer_id) - 1) % 5 AS INTEGER) AS fold
  FROM mart)"""


@register("kfold_assign", sql(*CHAIN, _KFOLD, body="SELECT customer_id, churn_flag, fold FROM kf"))
def kfold_assign(spark, sf):
    return S.kfold_assign(mart_df(spark, sf), 5).select("customer_id", "churn_flag", "fold")


@register("exact_stratified_split", sql(*CHAIN, _EXACT, body="""
SELECT customer_id, churn_flag, CASE WHEN position <= ceil(label_rows * 0.2) THEN 'test'
  WHEN position <= ceil(label_rows * 0.4) THEN 'validation' ELSE 'train' END AS split FROM ex"""))
def exact_stratified_split(spark, sf):
    return S.exact_stratified_split(mart_df(spark, sf)).select("customer_id", "churn_flag", "split")


def _overlap_sql():
    from churnlake.schemas import FEATURE_COLUMNS
    cols = ", ".join(FEATURE_COLUMNS)
    q = lambda a: f"(SELECT {cols} FROM split WHERE split = '{a}')"
    return sql(*CHAIN, SPLIT, body=f"""
SELECT 'train' AS split_a, 'validation' AS split_b, CAST(count(*) AS BIGINT) AS shared_feature_rows
FROM ({q('train')} INTERSECT {q('validation')})
UNION ALL
SELECT 'train', 'test', CAST(count(*) AS BIGINT) FROM ({q('train')} INTERSECT {q('test')})
UNION ALL
SELECT 'validation', 'test', CAST(count(*) AS BIGINT) FROM ({q('validation')} INTERSECT {q('test')})""")


@register("split_overlap", _overlap_sql())
def split_overlap(spark, sf):
    from churnlake.operators.features import shared_rows
    s = S.hash_split(mart_df(spark, sf))
    return shared_rows(s, "split", [("train", "validation"), ("train", "test"), ("validation", "test")])


# --- grouped evaluations ---------------------------------------------------

@register("overfit_gaps", sql(*CHAIN, LABELLED, SPLIT, """
ls AS (SELECT l.*, s.split FROM labelled l JOIN split s USING (customer_id) WHERE s.split IN ('train', 'validation'))""",
    _pr_cte("ls", "split"), _rank_cte("pr_f", "split"), _conf_cte("ls", "0.5", "split"), body="""
, per AS (SELECT r.split, r.roc_auc, r.average_precision, c.f1 FROM rk r JOIN cf_m c USING (split))
SELECT 'labelled_scores' AS model,
  round(max(roc_auc) FILTER (WHERE split = 'train'), 6) AS train_roc_auc,
  round(max(roc_auc) FILTER (WHERE split = 'validation'), 6) AS validation_roc_auc,
  round(max(roc_auc) FILTER (WHERE split = 'train') - max(roc_auc) FILTER (WHERE split = 'validation'), 6) AS roc_auc_gap,
  round(max(average_precision) FILTER (WHERE split = 'train'), 6) AS train_average_precision,
  round(max(average_precision) FILTER (WHERE split = 'validation'), 6) AS validation_average_precision,
  round(max(average_precision) FILTER (WHERE split = 'train') - max(average_precision) FILTER (WHERE split = 'validation'), 6) AS average_precision_gap,
  round(max(f1) FILTER (WHERE split = 'train'), 6) AS train_f1,
  round(max(f1) FILTER (WHERE split = 'validation'), 6) AS validation_f1,
  round(max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'validation'), 6) AS f1_gap
FROM per"""))
def overfit_gaps(spark, sf):
    from churnlake.plans.evaluation import overfit_table
    ls = labelled_split(spark, sf)
    dev = ls.filter(F.col("split").isin("train", "validation"))
    return round_doubles(overfit_table(dev, "labelled_scores", bounds=M.score_bounds(ls)))
