"""Invariants and golden values (FIXTURES.md §4-§5) on the derived tables."""

import pytest
from pyspark.sql import functions as F

from churnlake.operators import metrics as M
from churnlake.operators import splits as S
from churnlake.queries.common import mart_df, predictions_df, raw_df
from churnlake.registry import queries

SF = "/root/testdata/sf0.001"


def test_fixture_golden_counts(spark):
    raw = raw_df(spark, SF)
    r = raw.agg(F.count("*").alias("n"),
                F.count_if(F.col("attrition_flag") == "Attrited Customer").alias("churn"),
                F.count_if(F.col("total_amt_chng_q4_q1").isNull()).alias("null_amt")).collect()[0]
    assert (r.n, r.churn, r.null_amt) == (150, 30, 33)
    assert len(raw.columns) == 23


def test_layers_reconcile(spark):
    rec = {r.dataset: (r.rows, r.unique_customers, r.churn_customers)
           for r in queries()["layer_reconciliation"](spark, SF).collect()}
    assert rec["raw"] == rec["staging"] == rec["mart"] == (150, 150, 30)


def test_bands_sum_and_high_iff_prediction(spark):
    s = queries()["portfolio_summary"](spark, SF).collect()[0]
    assert s.low_risk_customers + s.medium_risk_customers + s.high_risk_customers == s.total_customers
    assert s.high_risk_customers == s.predicted_churn_customers
    assert s.minimum_model_version == s.maximum_model_version
    bad = predictions_df(spark, SF).filter((F.col("risk_band") == "High") != (F.col("churn_prediction") == 1)).count()
    assert bad == 0


def test_labelled_score_golden_values(spark):
    lab = S.labelled_scores(mart_df(spark, SF))
    pr = M.pr_table(lab)
    rk = M.ranking_metrics(pr).collect()[0]
    assert rk.average_precision == pytest.approx(0.774551, abs=1e-6)
    assert rk.roc_auc == pytest.approx(0.901111, abs=1e-6)
    assert pr.count() == 127
    best = M.best_f1_threshold(pr).collect()[0]
    assert best.threshold == pytest.approx(0.574) and best.f1 == pytest.approx(0.693878, abs=1e-6)
    watch = M.watchlist_threshold(pr).collect()[0]
    assert watch.threshold == pytest.approx(0.574)


def test_splits_disjoint_complete(spark):
    s = S.hash_split(mart_df(spark, SF))
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 97, "validation": 20, "test": 33}
    folds = S.kfold_assign(mart_df(spark, SF), 5)
    assert folds.count() == 150 and folds.select("customer_id").distinct().count() == 150
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 2


def test_rescore_mismatch_only_between_cuts(spark):
    rc = queries()["rescore_compare"](spark, SF)
    p = predictions_df(spark, SF).select("customer_id", "churn_probability")
    bad = (rc.join(p, "customer_id").filter(~F.col("matches_stored_prediction"))
           .filter(~F.col("churn_probability").between(0.4762, 0.5)).count())
    assert bad == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
