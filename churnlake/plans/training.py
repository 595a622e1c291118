"""A model's way from fit to final report: cuts, refit, ledger, documents.

A learner is ``fit_and_score(fit_rows, target_rows) -> (customer_id, label,
score)``, so any of the learners takes the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import metrics as M
from churnlake.operators.prefix import materialize
from churnlake.plans.evaluation import METRICS, final_test_report
from churnlake.schemas import (CATEGORICAL_FEATURES, CLASSIFICATION_THRESHOLD, FEATURE_COLUMNS, NUMERIC_FEATURES, RISK_BANDS,
                               WATCHLIST_MIN_PRECISION, WATCHLIST_THRESHOLD)

Learner = Callable[[DataFrame, DataFrame], DataFrame]


def naive_bayes_learner(fit_rows: DataFrame, target: DataFrame) -> DataFrame:
    from churnlake.operators import naive_bayes as NB
    return NB.predict(NB.fit(fit_rows), target).select("customer_id", "label", "score")


def learner_of(name: str) -> Learner:
    """A learner of ``learners.LEARNERS`` with its preparation."""
    from churnlake.operators import learners as L

    def run(fit_rows: DataFrame, target: DataFrame) -> DataFrame:
        both = fit_rows.withColumn("train", F.lit(True)).unionByName(target.withColumn("train", F.lit(False)))
        prepared = L.prepare(both.withColumn("fit", F.lit(0)).withColumnRenamed("churn_flag", "label"))
        scores, _, errors = L.score_learners(prepared, [name])
        if errors:
            raise RuntimeError(f"{name} could not be fitted: {errors}")
        return scores.select("customer_id", "label", "score")
    return run


def trained_report(split: DataFrame, learner: Learner, model: str) -> DataFrame:
    """Fit on train; best-F1 and watchlist cuts on validation; refit on both;
    metrics of the test split at the default cut and these two. Scores count
    to 9 decimals, so that a cut is the same number wherever it is applied."""
    rows = materialize(split)
    on = lambda *names: rows.filter(F.col("split").isin(*names))
    scored = lambda fit, target: materialize(learner(fit, target).withColumn(
        "score", F.round("score", 9)).filter(F.col("label").isNotNull()))
    val = scored(on("train"), on("validation"))
    pr = M.pr_table(val, bounds=M.score_bounds(val))
    cuts = {"default": 0.5, "best_f1": M.best_f1_threshold(pr).select("threshold").scalar(),
            "watchlist": M.watchlist_threshold(pr, WATCHLIST_MIN_PRECISION).select("threshold").scalar()}
    test = scored(on("train", "validation"), on("test"))
    return materialize(final_test_report(test, cuts, model, bounds=M.score_bounds(test)))


def training_ledger_rows(split: DataFrame, report: DataFrame, run_name: str) -> DataFrame:
    """(run_name, kind, key, value_text, value_double) of one training run."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    row = lambda kind, key, t, d: F.struct(
        F.lit(run_name).alias("run_name"), F.lit(kind).alias("kind"), key.alias("key"), t.alias("value_text"),
        d.alias("value_double"))
    cuts = report.select(F.explode(F.array(
        *[row("metric", F.concat(F.lit(f"test_{m}_"), F.col("threshold_name")), text, F.col(m)) for m in METRICS],
        row("param", F.concat(F.lit("threshold_"), F.col("threshold_name")),
            F.round(F.col("threshold") * 1e9).cast("bigint").cast("string"), number))).alias("r"))
    counts = split.agg(
        F.count_if(F.col("split").isin("train", "validation") & F.col("churn_flag").isNotNull()).alias("dev"),
        F.count_if(F.col("split") == "test").alias("test"))
    rows = counts.select(F.explode(F.array(
        row("param", F.lit("development_rows"), F.col("dev").cast("string"), number),
        row("param", F.lit("test_rows"), F.col("test").cast("string"), number),
        row("tag", F.lit("stage"), F.lit("final"), number))).alias("r"))
    return cuts.unionByName(rows).select("r.*")


def training_documents(split: DataFrame, report: DataFrame) -> DataFrame:
    """(document, body): features, pipeline validation, thresholds and final results as JSON text."""
    entries = lambda key, value: F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(key, value)))))
    sizes = split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(
        entries(F.concat("split", F.lit("_rows")), F.col("n").cast("double")).alias("body"))
    # the cuts found, and the lower end of each band that scoring uses
    ends = {"Low": 0.0, "Medium": WATCHLIST_THRESHOLD, "High": CLASSIFICATION_THRESHOLD}
    bands = F.array(*[F.struct(F.lit(f"band.{b}").alias("k"), F.lit(ends[b]).alias("v")) for b in RISK_BANDS])
    named = F.collect_list(F.struct(F.col("threshold_name").alias("k"), F.col("threshold").alias("v")))
    cuts = report.agg(F.to_json(F.map_from_entries(F.sort_array(F.concat(named, bands)))).alias("body"))
    final = report.select("threshold_name", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in METRICS])).alias("e")).agg(
        entries(F.concat("threshold_name", F.lit("."), F.col("e.m")), F.col("e.v")).alias("body"))
    kinds = split.limit(1).agg(F.to_json(F.create_map(
        F.lit("numeric"), F.lit(float(len(NUMERIC_FEATURES))), F.lit("categorical"),
        F.lit(float(len(CATEGORICAL_FEATURES))),
        *[x for i, c in enumerate(FEATURE_COLUMNS) for x in (F.lit(f"position.{c}"), F.lit(float(i + 1)))])).alias("body"))
    out = None
    for name, df in (("features", kinds), ("pipeline_validation", sizes), ("thresholds", cuts),
                     ("final_results", final)):
        row = df.select(F.lit(name).alias("document"), "body")
        out = row if out is None else out.unionByName(row)
    return out


def document_fields(docs: DataFrame) -> DataFrame:
    """(document, field, micros) parsed from the JSON bodies."""
    return docs.select("document", F.explode(F.from_json("body", "map<string,double>")).alias("field", "v")).select(
        "document", "field", F.round(F.col("v") * 1e6).cast("bigint").alias("micros"))
