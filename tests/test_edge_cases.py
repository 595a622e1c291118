"""Hand-sized frames for the semantics that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from churnlake.functions.columns import risk_band, threshold_predict
from churnlake.operators import features as FT
from churnlake.operators import metrics as M
from churnlake.operators import quality as Q
from churnlake.plans import layers, serving
from churnlake.schemas import RAW_SCHEMA
from churnlake.sources import ledger


def _raw_rows(spark, labels):
    base = {f.name: None for f in RAW_SCHEMA.fields}
    rows = []
    for i, lab in enumerate(labels):
        r = dict(base, client_num=i + 1, attrition_flag=lab, gender=" F")
        rows.append(tuple(r[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_case_without_else_and_trim_asymmetry(spark):
    raw = _raw_rows(spark, [" Attrited Customer", "Existing Customer", "Attrited Customer", "other", None])
    got = {r.customer_id: (r.attrition_status, r.churn_flag, r.gender)
           for r in layers.stage(raw).collect()}
    assert got[1] == ("Attrited Customer", None, "F")   # trimmed status, NULL flag
    assert got[2] == ("Existing Customer", 0, "F")
    assert got[3] == ("Attrited Customer", 1, "F")
    assert got[4] == ("other", None, "F")
    assert got[5] == (None, None, "F")
    nn = {(r.layer, r.column_name): r.failures
          for r in Q.not_null_failures(layers.stage(raw), "staging", ["churn_flag"]).collect()}
    assert nn[("staging", "churn_flag")] == 3


def test_unique_ignores_null_and_pandas_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k long")
    u = Q.unique_failures(df, "raw", "k").collect()[0]
    assert (u.failures, u.failing_rows) == (1, 2)
    dup = df.agg(Q.duplicate_rows("k").alias("d")).collect()[0].d
    assert dup == 2  # one extra 1 and one extra NULL


def test_band_boundaries_and_guards(spark):
    df = spark.createDataFrame([(0.2075,), (0.4762,), (0.5,), (0.0,), (1.0,), (None,), (float("nan"),)], "p double")
    out = df.select("p", risk_band("p", 0.2075, 0.4762).alias("b"),
                    threshold_predict("p", 0.4762).alias("y")).collect()
    bands = [r.b for r in out]
    assert bands == ["Medium", "High", "High", "Low", "High", "High", "High"]
    ys = [r.y for r in out]
    assert ys[:5] == [0, 1, 1, 0, 1] and ys[5] is None and ys[6] == 1  # Spark: NaN >= t is true
    pred = df.select(F.monotonically_increasing_id().alias("customer_id"), F.col("p").alias("churn_probability"),
                     risk_band("p", 0.2075, 0.4762).alias("risk_band"), F.lit(3).alias("model_version"),
                     F.lit("champion").alias("model_alias"))
    exp = {r.expectation: r.failures for r in Q.scoring_expectations(pred).collect()}
    assert exp["null_or_nan_probability"] == 2


def _pred_frame(spark, rows):
    return spark.createDataFrame(
        rows, "customer_id long, churn_probability double, risk_band string, churn_prediction int, "
              "model_name string, model_version int, model_alias string, scored_at timestamp")


def test_orphan_prediction_and_missing_prediction(spark):
    import datetime as dt
    ts = dt.datetime(2024, 1, 1)
    preds = _pred_frame(spark, [(1, 0.9, "High", 1, "m", 3, "champion", ts),
                                (99, 0.95, "High", 1, "m", 3, "champion", ts)])  # 99 is an orphan
    mart = spark.createDataFrame([(1, 40, "F"), (2, 50, "M")], "customer_id long, customer_age int, gender string")
    page = serving.customer_list(preds, mart, "High", 10, 0).collect()
    assert [r.customer_id for r in page] == [1]
    assert serving.customer_list_total(preds, "High").collect()[0].total_matching == 2
    with pytest.raises(ValueError):
        serving.customer_list(preds, mart, "Extreme", 10, 0)
    with pytest.raises(ValueError):
        serving.customer_list(preds, mart, None, 101, 0)
    with pytest.raises(ValueError):
        serving.customer_list(preds, mart, None, 10, -1)


def test_empty_summary(spark):
    s = serving.portfolio_summary(_pred_frame(spark, [])).collect()[0]
    assert s.total_customers == 0 and s.predicted_churn_customers == 0
    assert s.predicted_churn_rate == 0.0 and s.average_churn_probability == 0.0
    assert s.minimum_model_version is None and s.model_alias is None and s.latest_scoring_at is None


def test_average_precision_and_auc_small(spark):
    scores = [.9, .8, .8, .6, .5, .4, .3, .2]
    labels = [1, 0, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    r = M.ranking_metrics(M.pr_table(df, buckets=3)).collect()[0]
    assert r.average_precision == pytest.approx(0.691667, abs=1e-6)
    assert r.roc_auc == pytest.approx(0.59375, abs=1e-9)


def test_prefix_sums_match_single_window(spark):
    from pyspark.sql import Window
    from churnlake.operators.prefix import running_sums
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("v"), F.lit(1).alias("c"))
    g = df.groupBy("v").agg(F.sum("c").alias("c"))
    got = {r.v: r.cum_c for r in running_sums(g, "v", ["c"], buckets=7).collect()}
    w = Window.orderBy(F.col("v").desc())
    want = {r.v: r.cc for r in g.select("v", F.sum("c").over(w).alias("cc")).collect()}
    assert got == want


def test_one_hot_unseen_and_null(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id long, c string")
    other = spark.createDataFrame([(3, "a"), (4, "z"), (5, None)], "customer_id long, c string")
    got = {r.customer_id: r.category_index for r in FT.category_index(train, other, ["c"]).collect()}
    assert got == {3: 0, 4: None, 5: None}


def test_median_and_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (6.0,), (None,)], "x double")
    med = FT.exact_medians(df, ["x"]).collect()[0].median
    assert med == 2.5
    st = FT.moments(df, ["x"]).collect()[0]
    assert st.std == pytest.approx(1.870829, abs=1e-6)
    mode = FT.modes(spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string"), ["c"]).collect()[0]
    assert mode.mode == "a"  # tie -> smallest value


def test_numeric_version_max(spark):
    reg = spark.createDataFrame([("m", "9", None), ("m", "10", "champion")], "model_name string, version string, alias string")
    r = ledger.latest_versions(reg).collect()[0]
    assert r.latest_version == 10 and r.champion_version == 10


def test_record_contract(spark):
    recs = spark.createDataFrame([
        ("ok", '{"customer_age": 40, "gender": "F", "dependent_count": 1, "education_level": "x", '
               '"marital_status": "y", "income_category": "z", "card_category": "Blue", "months_on_book": 3, '
               '"total_relationship_count": 2, "months_inactive_last_12m": 1, "contacts_count_last_12m": 0, '
               '"credit_limit": 1.5, "total_revolving_balance": 0, "average_open_to_buy": 2.5, '
               '"amount_change_q4_q1": 0.5, "total_transaction_amount": 10, "total_transaction_count": 5, '
               '"transaction_count_change_q4_q1": 1.0, "average_utilization_ratio": 0.1}'),
        ("bad", '{"customer_age": "forty", "dependent_count": "5.0", "unknown_field": 1}'),
        ("junk", "not json"),
    ], "record_id string, record string")
    got = {r.record_id: r for r in Q.contract_check(recs).collect()}
    assert got["ok"].is_valid and got["ok"].customer_age == 40
    bad = got["bad"].reasons.split(";")
    assert "type:customer_age" in bad and "type:dependent_count" in bad and "extra:unknown_field" in bad
    assert "missing:gender" in bad and not got["bad"].is_valid
    assert got["junk"].reasons == "not_an_object"


def test_page_exact_when_orphans_exceed_first_candidates(spark):
    import datetime as dt
    ts = dt.datetime(2024, 1, 1)
    rows = [(1000 + i, 0.99, "High", 1, "m", 3, "champion", ts) for i in range(70)]  # orphans, ranked first
    rows += [(1, 0.90, "High", 1, "m", 3, "champion", ts), (2, 0.80, "High", 1, "m", 3, "champion", ts)]
    preds = _pred_frame(spark, rows)
    mart = spark.createDataFrame([(1, 40, "F"), (2, 50, "M")], "customer_id long, customer_age int, gender string")
    assert [r.customer_id for r in serving.customer_list(preds, mart, "High", 1, 0).collect()] == [1]
    assert [r.customer_id for r in serving.customer_list(preds, mart, None, 5, 1).collect()] == [2]
