"""Training-side queries: CV, final test report, prior baseline, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import features as FT
from churnlake.operators import metrics as M
from churnlake.operators import splits as S
from churnlake.operators.prefix import materialize
from churnlake.oracle import CHAIN, LABELLED, SPLIT, sql
from churnlake.plans import evaluation as E
from churnlake.queries.common import mart_df
from churnlake.queries.metrics import (_BEST_F1, _WATCH, EXACT_SPLIT, _conf_cte, _pr_cte, _rank_cte, exact_split,
                                       labelled_split)
from churnlake.registry import register, round_doubles
from churnlake.schemas import (CATEGORICAL_FEATURES, CLASSIFICATION_THRESHOLD, FEATURE_COLUMNS, NUMERIC_FEATURES,
                               WATCHLIST_MIN_PRECISION, WATCHLIST_THRESHOLD)

_LS = """
ls AS (SELECT l.*, s.split FROM labelled l JOIN split s USING (customer_id))"""

_DEV_FOLDS = """
dev AS (SELECT * FROM ls WHERE split IN ('train', 'validation')),
dvf AS (
  SELECT customer_id, label, score,
    CAST((row_number() OVER (PARTITION BY label ORDER BY
      CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT), customer_id) - 1) % 5 AS INTEGER) AS fold
  FROM dev)"""


@register("cv_summary", sql(*CHAIN, LABELLED, SPLIT, _LS, _DEV_FOLDS, _pr_cte("dvf", "fold"),
                            _rank_cte("pr_f", "fold"), _conf_cte("dvf", "0.5", "fold"), body="""
, per AS (SELECT r.fold, r.roc_auc, r.average_precision, c.f1 FROM rk r JOIN cf_m c USING (fold))
SELECT 'labelled_scores' AS model, CAST(count(*) AS BIGINT) AS folds,
  round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_pop(roc_auc), 6) AS roc_auc_std,
  round(avg(average_precision), 6) AS average_precision_mean, round(stddev_pop(average_precision), 6) AS average_precision_std,
  round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std
FROM per"""))
def cv_summary(spark, sf):
    ls = labelled_split(spark, sf)
    bounds = M.score_bounds(ls)
    dev = ls.filter(F.col("split").isin("train", "validation"))
    folds = S.kfold_assign(dev, 5, label="label").withColumn("model", F.lit("labelled_scores"))
    return round_doubles(E.cv_summary(folds, bounds=bounds))


def _final_sql(rounding="round", digits=6):
    val = _pr_cte("lv", None, "pr")

    def r(x):
        return f"{rounding}({x}, {digits})"

    parts = []
    for name, t in (("default", "0.5"), ("best_f1", "(SELECT threshold FROM best)"),
                    ("watchlist", "(SELECT threshold FROM watch)")):
        parts.append(_conf_cte("lt", t, None, f"cf_{name}"))
    body = "\nUNION ALL\n".join(
        f"SELECT 'labelled_scores' AS model, '{n}' AS threshold_name, CAST({t} AS DOUBLE) AS threshold, "
        f"{r('rt.roc_auc')} AS roc_auc, {r('rt.average_precision')} AS average_precision, "
        f"{r('c.accuracy')} AS accuracy, {r('c.balanced_accuracy')} AS balanced_accuracy, "
        f"{r('c.precision')} AS precision, {r('c.recall')} AS recall, {r('c.f1')} AS f1 "
        f"FROM rt, cf_{n}_m c"
        for n, t in (("default", "0.5"), ("best_f1", "(SELECT threshold FROM best)"),
                     ("watchlist", "(SELECT threshold FROM watch)")))
    return sql(*CHAIN, LABELLED, SPLIT, _LS, """
lv AS (SELECT * FROM ls WHERE split = 'validation'),
lt AS (SELECT * FROM ls WHERE split = 'test')""", val, _BEST_F1, _WATCH, _pr_cte("lt", None, "pt"),
               _rank_cte("pt_f", None, "rt"), *parts, body=body)


def _final_report(spark, sf):
    """Default, best-F1 and watchlist cuts of the validation split, applied to the test split."""
    ls = labelled_split(spark, sf)
    bounds = M.score_bounds(ls)
    pr = M.pr_table(ls.filter(F.col("split") == "validation"), bounds=bounds)
    thresholds = {
        "default": 0.5,
        "best_f1": M.best_f1_threshold(pr).select("threshold").scalar(),
        "watchlist": M.watchlist_threshold(pr, WATCHLIST_MIN_PRECISION).select("threshold").scalar(),
    }
    return E.final_test_report(ls.filter(F.col("split") == "test"), thresholds, "labelled_scores", bounds=bounds)


@register("final_test_report", _final_sql())
def final_test_report(spark, sf):
    return round_doubles(_final_report(spark, sf))


@register("metrics_long", sql(*CHAIN, LABELLED, SPLIT, _LS, _pr_cte("ls", "split"), _rank_cte("pr_f", "split"), body="""
SELECT split, metric, round(value, 6) AS value FROM rk
UNPIVOT (value FOR metric IN (roc_auc, average_precision))"""))
def metrics_long(spark, sf):
    ls = labelled_split(spark, sf)
    rk = M.ranking_metrics(M.pr_table(ls, group_cols=["split"], bounds=M.score_bounds(ls)), ["split"])
    return round_doubles(E.metrics_long(rk, ["split"], ["roc_auc", "average_precision"]))


@register("model_prior", sql(*CHAIN, EXACT_SPLIT, """
pv AS (
  SELECT customer_id, churn_flag AS label,
    (SELECT avg(churn_flag) FROM split WHERE split = 'train') AS score
  FROM split WHERE split = 'validation')""", _pr_cte("pv"), _rank_cte("pr_f"), _conf_cte("pv", "0.5"), body=f"""
SELECT 'prior' AS model, 0.5::DOUBLE AS threshold, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, round(accuracy, 6) AS accuracy,
  round(balanced_accuracy, 6) AS balanced_accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1
FROM rk, cf_m"""))
def model_prior(spark, sf):
    from churnlake.operators.learners import prior_scores
    s = materialize(exact_split(spark, sf).select("customer_id", "churn_flag", "split"))
    scored = prior_scores(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "validation"))
    return round_doubles(M.evaluate_predictions(scored, 0.5, model="prior"))


# --- feature preparation -----------------------------------------------------

def _train(spark, sf):
    return materialize(S.hash_split(mart_df(spark, sf)).filter(F.col("split") == "train"))


@register("impute_median", sql(*CHAIN, SPLIT, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median "
    f"FROM split WHERE split = 'train'" for c in NUMERIC_FEATURES)))
def impute_median(spark, sf):
    return round_doubles(FT.exact_medians(_train(spark, sf), NUMERIC_FEATURES))


@register("impute_mode", sql(*CHAIN, SPLIT, body="\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS mode FROM split WHERE split = 'train' AND {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATEGORICAL_FEATURES)))
def impute_mode(spark, sf):
    return FT.modes(_train(spark, sf), CATEGORICAL_FEATURES)


def _scale_sql():
    med = ",\n".join(f"  (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM split WHERE split = 'train') AS m_{c}"
                     for c in NUMERIC_FEATURES)
    imp = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), md.m_{c}) AS {c}" for c in NUMERIC_FEATURES)
    st = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC_FEATURES)
    out = ", ".join(f"round(({c} - st.mu_{c}) / coalesce(nullif(st.sd_{c}, 0), 1.0), 6) AS {c}"
                    for c in NUMERIC_FEATURES)
    return sql(*CHAIN, SPLIT, f"""
md AS (SELECT
{med}),
imp AS (SELECT s.customer_id, s.split, {imp} FROM split s, md),
st AS (SELECT {st} FROM imp WHERE split = 'train')""", body=f"SELECT customer_id, {out} FROM imp, st")


@register("standard_scale", _scale_sql())
def standard_scale(spark, sf):
    s = S.hash_split(mart_df(spark, sf))
    train = _train(spark, sf)
    imp = FT.fit_imputer(train, NUMERIC_FEATURES, [])
    params = FT.fit_scaler(FT.apply_imputer(train.select(*NUMERIC_FEATURES), imp), NUMERIC_FEATURES)
    scaled = FT.apply_scaler(FT.apply_imputer(s.select("customer_id", *NUMERIC_FEATURES), imp), params)
    return round_doubles(scaled)


@register("one_hot", sql(*CHAIN, SPLIT, """
cats AS (
  SELECT column_name, value AS category,
    CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS category_index
  FROM (SELECT DISTINCT column_name, value FROM (
    SELECT * FROM (SELECT gender, education_level, marital_status, income_category, card_category FROM split WHERE split = 'train')
    UNPIVOT (value FOR column_name IN (gender, education_level, marital_status, income_category, card_category))))),
lng AS (
  SELECT customer_id, column_name, value AS category FROM (
    SELECT customer_id, gender, education_level, marital_status, income_category, card_category FROM split)
  UNPIVOT INCLUDE NULLS (value FOR column_name IN (gender, education_level, marital_status, income_category, card_category)))""",
    body="""
SELECT l.customer_id, l.column_name, l.category, c.category_index
FROM lng l LEFT JOIN cats c ON c.column_name = l.column_name AND c.category = l.category"""))
def one_hot(spark, sf):
    s = S.hash_split(mart_df(spark, sf))
    return FT.category_index(s.filter(F.col("split") == "train"), s, CATEGORICAL_FEATURES)


@register("dq_thresholds", sql(*CHAIN, LABELLED, SPLIT, _LS, """
lv AS (SELECT * FROM ls WHERE split = 'validation')""", _pr_cte("lv", None, "pr"), _BEST_F1, _WATCH, body="""
SELECT (SELECT threshold FROM watch) AS watchlist_threshold, (SELECT threshold FROM best) AS classification_threshold,
  (SELECT threshold FROM watch) > 0 AS watchlist_positive,
  (SELECT threshold FROM watch) < (SELECT threshold FROM best) AS watchlist_below_classification,
  (SELECT threshold FROM best) < 1 AS classification_below_one,
  (SELECT CAST(count(*) AS BIGINT) FROM ls WHERE split IN ('train', 'validation')) AS development_rows"""))
def dq_thresholds(spark, sf):
    from churnlake.functions.columns import with_row
    from churnlake.operators.quality import threshold_expectations
    ls = labelled_split(spark, sf)
    pr = M.pr_table(ls.filter(F.col("split") == "validation"), bounds=M.score_bounds(ls))
    t = with_row(M.best_f1_threshold(pr).select(F.col("threshold").alias("classification_threshold")),
                 M.watchlist_threshold(pr, WATCHLIST_MIN_PRECISION).select(
                     F.col("threshold").alias("watchlist_threshold")))
    # best-F1 always exists on a non-empty split; the watchlist one may not
    checks = threshold_expectations(t)
    dev = ls.filter(F.col("split").isin("train", "validation")).agg(
        F.count(F.lit(1)).cast("bigint").alias("development_rows"))
    return with_row(with_row(t, checks), dev).select(
        "watchlist_threshold", "classification_threshold", "watchlist_positive",
        "watchlist_below_classification", "classification_below_one", "development_rows")


def _importance_sql(repeats: int = 10, seed: int = 42):
    from churnlake.oracle import PROB
    from churnlake.schemas import FEATURE_COLUMNS
    feats = FEATURE_COLUMNS
    hb = f"CAST(('0x' || substr(md5('perm-base:{seed}:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT)"
    hp = (f"CAST(('0x' || substr(md5('perm:{seed}:' || CAST(r.rep AS VARCHAR) || ':' "
          f"|| CAST(v.customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT)")
    repl = ", ".join(f"CASE WHEN k.feature = '{f}' THEN d.{f} ELSE b.{f} END AS {f}" for f in feats)
    names = ", ".join(f"('{f}')" for f in feats)
    ctes = f"""
v AS (SELECT customer_id, churn_flag AS label, {", ".join(feats)} FROM split WHERE split = 'validation'),
base AS (SELECT *, row_number() OVER (ORDER BY {hb}, customer_id) AS position FROM v),
don AS (
  SELECT r.rep, v.*, row_number() OVER (PARTITION BY r.rep ORDER BY {hp}, v.customer_id) AS position
  FROM v CROSS JOIN (SELECT range AS rep FROM range({repeats})) r),
perm AS (SELECT k.feature, d.rep, b.label, {repl}
  FROM base b JOIN don d ON d.position = b.position CROSS JOIN (VALUES {names}) k(feature)),
ps AS (SELECT feature, rep, label, {PROB} AS score FROM perm),
bs AS (SELECT label, {PROB} AS score FROM v)"""
    return sql(*CHAIN, SPLIT, ctes, _pr_cte("ps", "feature, rep", "pp"), _rank_cte("pp_f", "feature, rep", "prk"),
               _pr_cte("bs", None, "bp"), _rank_cte("bp_f", None, "brk"), body="""
SELECT r.feature, round(avg(b.average_precision - r.average_precision), 6) + 0.0 AS importance_mean,
  round(stddev_pop(b.average_precision - r.average_precision), 6) + 0.0 AS importance_std
FROM prk r, brk b GROUP BY r.feature""")


@register("permutation_importance", _importance_sql())
def permutation_importance(spark, sf):
    from churnlake.functions.columns import fixed_score
    from churnlake.operators.importance import permutation_importance as pi
    from churnlake.schemas import FEATURE_COLUMNS
    val = S.hash_split(mart_df(spark, sf)).filter(F.col("split") == "validation")
    imp = pi(val, fixed_score, FEATURE_COLUMNS, repeats=10, seed=42)
    return imp.select("feature", (F.round("importance_mean", 6) + F.lit(0.0)).alias("importance_mean"),
                      (F.round("importance_std", 6) + F.lit(0.0)).alias("importance_std"))


def _prep_ctes(p: str, fit: str, target: str) -> str:
    """CTEs <p>itr / <p>iva: imputed fit and target rows, <p>st: moments; ``fit`` and ``target`` are lists of splits."""
    nums, cats = NUMERIC_FEATURES, CATEGORICAL_FEATURES
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in nums)
    mode = ", ".join(
        f"(SELECT {c} FROM {p}tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS o_{c}"
        for c in cats)
    imp_cols = lambda src: ", ".join(
        [f"coalesce(CAST({src}.{c} AS DOUBLE), md.m_{c}) AS {c}" for c in nums]
        + [f"coalesce({src}.{c}, mo.o_{c}) AS {c}" for c in cats])
    st = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in nums)
    return f"""
{p}tr AS (SELECT customer_id, churn_flag AS label, * EXCLUDE (customer_id, churn_flag) FROM split WHERE split IN ({fit}) AND churn_flag IS NOT NULL),
{p}va AS (SELECT customer_id, churn_flag AS label, * EXCLUDE (customer_id, churn_flag) FROM split WHERE split IN ({target})),
{p}md AS (SELECT {med} FROM {p}tr),
{p}mo AS (SELECT {mode}),
{p}itr AS (SELECT t.customer_id, t.label, {imp_cols('t')} FROM {p}tr t, {p}md md, {p}mo mo),
{p}iva AS (SELECT v.customer_id, v.label, {imp_cols('v')} FROM {p}va v, {p}md md, {p}mo mo),
{p}st AS (SELECT {st} FROM {p}itr)"""


def _gnb_ctes(p: str, fit: str, target: str) -> str:
    """The model fitted on ``fit``, with <p>j (customer_id, label, j0, j1) for ``target``."""
    nums, cats = NUMERIC_FEATURES, CATEGORICAL_FEATURES
    num_long = lambda src: "\n  UNION ALL\n  ".join(
        f"SELECT customer_id, label, '{c}' AS feature, ({c} - st.mu_{c}) / coalesce(nullif(st.sd_{c}, 0), 1.0) AS x "
        f"FROM {src}, {p}st st" for c in nums)
    cat_unpivot = lambda src: "\n  UNION ALL\n  ".join(
        f"SELECT customer_id, label, '{c}' AS column_name, {c} AS value FROM {src}" for c in cats)
    long = lambda src: f"""
  {num_long(src)}
  UNION ALL
  SELECT u.customer_id, u.label, c.column_name || '=' || c.category AS feature,
    CASE WHEN u.value = c.category THEN 1.0 ELSE 0.0 END AS x
  FROM ({cat_unpivot(src)}) u JOIN {p}catv c ON c.column_name = u.column_name"""  # noqa: E731
    return _prep_ctes(p, fit, target) + f""",
{p}catv AS (SELECT DISTINCT column_name, value AS category FROM ({cat_unpivot(p + 'itr')})),
{p}ltr AS ({long(p + 'itr')}),
{p}lva AS ({long(p + 'iva')}),
{p}eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT feature, var_pop(x) AS v FROM {p}ltr GROUP BY feature)),
{p}prm AS (SELECT label AS cls, feature, avg(x) AS mean, var_pop(x) + (SELECT e FROM {p}eps) AS var FROM {p}ltr GROUP BY label, feature),
{p}pri AS (SELECT label AS cls, ln(count(*) / (SELECT count(*) FROM {p}tr)) AS lp FROM {p}tr GROUP BY label),
{p}jll AS (
  SELECT l.customer_id, p.cls, sum(-0.5 * ln(2.0 * pi() * p.var) - (l.x - p.mean) * (l.x - p.mean) / (2.0 * p.var)) AS s
  FROM {p}lva l JOIN {p}prm p ON p.feature = l.feature GROUP BY l.customer_id, p.cls),
{p}j AS (
  SELECT v.customer_id, v.label,
    max(CASE WHEN j.cls = 0 THEN j.s + pr.lp END) AS j0, max(CASE WHEN j.cls = 1 THEN j.s + pr.lp END) AS j1
  FROM {p}va v JOIN {p}jll j ON j.customer_id = v.customer_id JOIN {p}pri pr ON pr.cls = j.cls
  GROUP BY v.customer_id, v.label)"""


def _gnb_sql():
    return sql(*CHAIN, EXACT_SPLIT, _gnb_ctes("", "'train'", "'validation'"), body="""
SELECT customer_id, label, round(1.0 / (1.0 + exp(j0 - j1)), 6) AS score, CAST(j1 > j0 AS INTEGER) AS prediction FROM j""")


@register("model_gaussian_nb", _gnb_sql())
def model_gaussian_nb(spark, sf):
    from churnlake.operators import naive_bayes as NB
    s = materialize(exact_split(spark, sf))
    model = NB.fit(s.filter(F.col("split") == "train"))
    return round_doubles(NB.predict(model, s.filter(F.col("split") == "validation")))


@register("model_spark_naive_bayes", _gnb_sql())
def model_spark_naive_bayes(spark, sf):
    """Spark ML's Gaussian naive Bayes on the same preparation; the same model as ``model_gaussian_nb``."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import vector_to_array
    from churnlake.operators.learners import Preprocessor
    s = materialize(exact_split(spark, sf))
    train = s.filter(F.col("split") == "train")
    prep = Preprocessor().fit(train)
    model = NaiveBayes(modelType="gaussian").fit(prep.transform(train))
    scored = model.transform(prep.transform(s.filter(F.col("split") == "validation")))
    return round_doubles(scored.select(
        "customer_id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction")))


@register("final_test_report_display", _final_sql("round_even", 4))
def final_test_report_display(spark, sf):
    """The final report as displayed: metrics rounded half-to-even to 4
    decimals (pandas' rounding), not half-up."""
    from churnlake.functions.columns import report_round
    return _final_report(spark, sf).select(
        "model", "threshold_name", "threshold", *[report_round(m, 4).alias(m) for m in E.METRICS])


# --- one trained model from fit to final report --------------------------------

_CHAIN_SCORES = """
lv AS (SELECT customer_id, label, round(1.0 / (1.0 + exp(j0 - j1)), 9) AS score FROM f_j),
lt AS (SELECT customer_id, label, round(1.0 / (1.0 + exp(j0 - j1)), 9) AS score FROM r_j)"""


def _trained_ctes():
    return [_gnb_ctes("f_", "'train'", "'validation'"), _gnb_ctes("r_", "'train', 'validation'", "'test'"),
            _CHAIN_SCORES, _pr_cte("lv", None, "pr"), _BEST_F1, _WATCH, _pr_cte("lt", None, "pt"),
            _rank_cte("pt_f", None, "rt")]


_CUTS = (("default", "0.5"), ("best_f1", "(SELECT threshold FROM best)"), ("watchlist", "(SELECT threshold FROM watch)"))


def _trained_sql():
    body = "\nUNION ALL\n".join(
        f"SELECT 'gaussian_nb' AS model, '{n}' AS threshold_name, round(CAST({t} AS DOUBLE), 6) AS threshold, "
        + "round(rt.roc_auc, 6) AS roc_auc, round(rt.average_precision, 6) AS average_precision, "
        + ", ".join(f"round(c.{m}, 6) AS {m}" for m in E.METRICS[2:]) + f" FROM rt, cf_{n}_m c" for n, t in _CUTS)
    return sql(*CHAIN, EXACT_SPLIT, *_trained_ctes(), *[_conf_cte("lt", t, None, f"cf_{n}") for n, t in _CUTS], body=body)


def _trained_report(split):
    from churnlake.plans.training import naive_bayes_learner, trained_report
    return trained_report(split, naive_bayes_learner, "gaussian_nb")


@register("trained_test_report", _trained_sql())
def trained_test_report(spark, sf):
    """Fit on train, cuts from the validation scores, refit on train and
    validation, one report on the test split at the three cuts."""
    return round_doubles(_trained_report(exact_split(spark, sf)))


@register("training_ledger", sql(*CHAIN, EXACT_SPLIT, *_trained_ctes(), *[
    _conf_cte("lt", t, None, f"cf_{n}") for n, t in _CUTS], body="\nUNION ALL\n".join(
    [f"SELECT 'gaussian_nb' AS run_name, 'metric' AS kind, 'test_{m}_{n}' AS key, NULL AS value_text, "
     f"round({'rt' if m in E.METRICS[:2] else 'c'}.{m}, 6) AS value_double FROM rt, cf_{n}_m c"
     for n, _ in _CUTS for m in E.METRICS]
    + [f"SELECT 'gaussian_nb', 'param', 'threshold_{n}', CAST(CAST(round({t} * 1e9) AS BIGINT) AS VARCHAR), NULL"
       for n, t in _CUTS]
    + ["SELECT 'gaussian_nb', 'param', 'development_rows', CAST(count(*) AS VARCHAR), NULL FROM r_tr",
       "SELECT 'gaussian_nb', 'param', 'test_rows', CAST(count(*) AS VARCHAR), NULL FROM r_va",
       "SELECT 'gaussian_nb', 'tag', 'stage', 'final', NULL"])))
def training_ledger(spark, sf):
    """Params (cuts in billionths, row counts), test metrics and tags of the trained run, appended and read back."""
    from churnlake.plans.training import training_ledger_rows
    from churnlake.session import new_table_path
    from churnlake.sources import ledger as LG
    split = materialize(exact_split(spark, sf))
    rows = training_ledger_rows(split, _trained_report(split), "gaussian_nb")
    path = LG.append_ledger(rows, new_table_path(spark, "ledger"))
    return round_doubles(LG.read_ledger(spark, path))


@register("training_documents", sql(*CHAIN, EXACT_SPLIT, *_trained_ctes(), *[
    _conf_cte("lt", t, None, f"cf_{n}") for n, t in _CUTS], body="\nUNION ALL\n".join(
    [f"SELECT 'final_results' AS document, '{n}.{m}' AS field, "
     f"CAST(round({'rt' if m in E.METRICS[:2] else 'c'}.{m} * 1e6) AS BIGINT) AS micros FROM rt, cf_{n}_m c"
     for n, _ in _CUTS for m in E.METRICS]
    + [f"SELECT 'thresholds', '{n}', CAST(round({t} * 1e6) AS BIGINT)" for n, t in _CUTS]
    + [f"SELECT 'thresholds', 'band.{b}', CAST(round({t} * 1e6) AS BIGINT)" for b, t in (
        ("Low", 0), ("Medium", WATCHLIST_THRESHOLD), ("High", CLASSIFICATION_THRESHOLD))]
    + [f"SELECT 'features', 'position.{c}', CAST({i + 1} * 1000000 AS BIGINT)" for i, c in enumerate(FEATURE_COLUMNS)]
    + ["SELECT 'pipeline_validation', split || '_rows', CAST(count(*) * 1000000 AS BIGINT) FROM split GROUP BY split",
       f"SELECT 'features', 'numeric', CAST({len(NUMERIC_FEATURES)} * 1000000 AS BIGINT)",
       f"SELECT 'features', 'categorical', CAST({len(CATEGORICAL_FEATURES)} * 1000000 AS BIGINT)"])))
def training_documents(spark, sf):
    """The run's four JSON documents, written as text, read back and parsed; numbers in millionths."""
    from churnlake.plans.training import document_fields, training_documents as documents
    from churnlake.session import new_table_path
    split = materialize(exact_split(spark, sf))
    docs = documents(split, _trained_report(split))
    path = new_table_path(spark, "documents")
    docs.write.mode("errorifexists").parquet(path)
    return document_fields(spark.read.parquet(path))
