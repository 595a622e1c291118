"""Fresh layers, NULL labels, publishing, unseen categories, neighbours, and the plans of eager inner jobs."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from churnlake.operators import splits as S
from churnlake.operators.prefix import running_sums
from churnlake.plans import publish as P
from churnlake.registry import queries
from churnlake.schemas import NUMERIC_FEATURES
from churnlake.session import new_table_path
from churnlake.sources import files

SF = "/root/testdata/sf0.001"


def test_changed_input_changes_the_answer(spark, tmp_path):
    for t in ("customer", "orders", "events", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    count = lambda: queries()["portfolio_summary"](spark, str(tmp_path)).first()["total_customers"]
    before = count()
    half = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey % 2 = 0").toPandas()
    os.remove(tmp_path / "customer.parquet")
    half.to_parquet(tmp_path / "customer.parquet")
    spark.catalog.refreshByPath(str(tmp_path))
    assert 0 < count() < before


def test_batch_scoring_scores(spark):
    plan = queries()["batch_scoring"](spark, SF)._jdf.queryExecution().toString()
    assert "orders.parquet" in plan and "EXP" in plan.upper()


def labelled(spark, n=100, nulls=10):
    return spark.range(n).select(F.col("id").alias("customer_id"), F.when(F.col("id") < nulls, F.lit(None).cast("int"))
                                 .otherwise((F.col("id") % 3 == 0).cast("int")).alias("churn_flag"))


def test_rows_without_label_are_a_stratum(spark):
    df = labelled(spark)
    folds = S.kfold_assign(df).collect()
    assert len(folds) == 100
    assert sorted(r.fold for r in folds if r.churn_flag is None) == sorted(list(range(5)) * 2)
    split = S.exact_stratified_split(df).collect()
    assert len(split) == 100 and sum(r.split == "test" for r in split if r.churn_flag is None) == 2


def test_running_sums_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", 1.0, 7)], "g string, x double, n long")
    got = {(r.g, r.x): r.cum_n for r in running_sums(df, "x", ["n"], ["g"], descending=False).collect()}
    assert got == {(None, 1.0): 2, (None, 3.0): 7, ("a", 1.0): 7}


def predictions(spark, n=10):
    return spark.range(n).select(
        F.col("id").alias("customer_id"), (F.col("id") / 10.0).alias("churn_probability"),
        F.when(F.col("id") < 3, "Low").when(F.col("id") < 5, "Medium").otherwise("High").alias("risk_band"),
        (F.col("id") >= 5).cast("int").alias("churn_prediction"), F.lit("m").alias("model_name"),
        F.lit(3).alias("model_version"), F.lit("champion").alias("model_alias"),
        F.to_timestamp(F.lit("2024-05-01 12:00:00")).alias("scored_at"))


def test_same_batch_replaces_itself(spark):
    root = new_table_path(spark, "curated")
    uri = P.batch_keys(predictions(spark), root).first()["snapshot_uri"]
    for _ in range(3):
        files.write_snapshot(predictions(spark), uri)
    snapshot = files.read_snapshot(spark, f"{root}/{P.SNAPSHOT_PREFIX}")
    assert snapshot.count() == 10 and files.read_snapshot(spark, f"{root}/{P.SNAPSHOT_PREFIX}", "2024-05-01").count() == 10
    assert files.read_snapshot(spark, f"{root}/{P.SNAPSHOT_PREFIX}", "2024-05-02").count() == 0


def test_published_uri_leads_to_the_snapshot(spark):
    paths = P.publish_batch(spark, predictions(spark), new_table_path(spark, "t"), new_table_path(spark, "curated"))
    lineage = files.read_parquet(spark, paths["lineage"])
    assert {r.snapshot_uri for r in lineage.collect()} == {paths["uri"]}
    back = P.recovered_snapshot(spark, lineage)
    assert back.count() == 10
    assert files.dataset_fingerprint(back, P.CONTENT).collect() == files.read_parquet(spark, paths["checksum"]).collect()


@pytest.mark.parametrize("change,name", [
    (lambda p: p.withColumn("churn_probability", F.lit(1.5)), "chk_churn_probability"),
    (lambda p: p.unionByName(p.limit(1)), "pk_duplicate"),
    (lambda p: p.withColumn("risk_band", F.lit("Huge")), "unknown_band"),
    (lambda p: p.withColumn("customer_id", F.lit(None).cast("long")), "pk_null")])
def test_bad_batches_are_refused_before_the_write(spark, change, name):
    table = new_table_path(spark, "t")
    with pytest.raises(ValueError, match=name):
        P.publish_batch(spark, change(predictions(spark)), table, new_table_path(spark, "curated"))
    assert not os.path.exists(table.removeprefix("file:"))


def test_unseen_category_is_all_zeros(spark):
    from churnlake.operators.learners import Preprocessor
    from churnlake.queries.common import mart_df
    mart = mart_df(spark, SF).filter("churn_flag is not null")
    prep = Preprocessor().fit(mart)
    rows = prep.transform(mart.withColumn("gender", F.lit("never seen"))).collect()
    known = len({r[0] for r in mart.select("gender").collect()})
    for r in rows[:20]:
        assert r.features.size == prep.width
        start = len(NUMERIC_FEATURES)
        assert not any(r.features.toArray()[start: start + known])


def test_exact_neighbour_takes_all_weight():
    import numpy as np
    from churnlake.operators.knn import nearest_scores
    num = np.array([[0.0], [0.0], [1.0], [2.0]])
    cat = np.array([["a"], ["b"], ["a"], ["a"]])
    y = np.array([1.0, 0.0, 0.0, 0.0])
    got = nearest_scores(num, cat, y, np.array([[0.0], [0.5], [0.0]]), np.array([["a"], ["a"], ["?"]]),
                         np.array([[1.0], [1.0], [0.0]]), 2)
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5)
    # an unknown category is all zeros: one indicator away from each fit row
    assert got[2] == pytest.approx(0.5)


def test_knn_rejects_no_row_and_bounds_its_model(spark):
    from churnlake.operators import knn
    from churnlake.queries.common import mart_df
    mart = mart_df(spark, SF)
    model = knn.fit(mart, max_fit_rows=20)
    assert len(model["rows"]) == 20
    assert knn.predict(model, mart).count() == mart.count()


@pytest.mark.parametrize("record,reasons", [
    ('{"gender": 5}', "type:gender"), ('{"gender": {"a": 1}}', "type:gender"), ('{"gender": true}', "type:gender"),
    ('{"customer_age": 45.0}', None), ('{"customer_age": 45.5}', "type:customer_age"),
    ('{"customer_age": "45"}', None), ('{"customer_age": "45.0"}', "type:customer_age"),
    ('{"customer_age": 99999999999}', "type:customer_age"), ('{"credit_limit": 5}', None),
    ('{"credit_limit": "x"}', "type:credit_limit"), ('{"credit_limit": [1]}', "type:credit_limit"),
    ("[1]", "not_an_object"), ("no json", "not_an_object"), ('{"other": 1}', "extra:other")])
def test_contract_by_json_type(spark, record, reasons):
    from churnlake.operators.quality import contract_check
    df = spark.createDataFrame([(1, record)], "record_id long, record string")
    got = contract_check(df).first()["reasons"].split(";")
    got = [r for r in got if not r.startswith("missing:")]
    assert got == ([] if reasons is None else [reasons])


def test_deep_page_equals_sorted_slice(spark):
    from churnlake.plans.serving import customer_list
    from churnlake.queries.common import mart_df, predictions_df
    pred, mart = predictions_df(spark, SF), mart_df(spark, SF)
    rows = sorted(((-r.churn_probability, r.customer_id) for r in pred.collect()))
    n = len(rows)
    page = customer_list(pred, mart, None, 10, n - 15).collect()
    assert [r.customer_id for r in page] == [i for _, i in rows[n - 15: n - 5]]
    assert customer_list(pred, mart, None, 10, n + 5).count() == 0


def test_eager_jobs_have_no_cartesian_product_or_scan_broadcast(spark, monkeypatch):
    """Plans that a query runs while it is built (written stage tables) obey the rules of the returned plan."""

    from pyspark.sql.readwriter import DataFrameWriter
    from test_plans import _broadcast_scans, _plan
    seen = []
    write = DataFrameWriter.parquet

    def spy(self, path, *a, **k):
        seen.append((_plan(self._df), _broadcast_scans(self._df)))
        return write(self, path, *a, **k)


    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("customer_list", "final_test_report", "permutation_importance", "kfold_assign",
                     "snapshot_matches_mart", "impute_median", "model_gaussian_nb"):
            queries()[name](spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(seen) > 6
    for plan, broadcasts in seen:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert broadcasts == []


@pytest.mark.parametrize("name,scans", [("dq_unique", 1), ("dq_accepted_values", 1), ("layer_reconciliation", 1),
                                        ("ingestion_profile", 1), ("dq_not_null", 1), ("split_overlap", 1)])
def test_audits_scan_the_orders_once(spark, name, scans):
    from test_plans import _initial_plan, _nodes
    df = queries()[name](spark, SF)
    found = [n for n in _nodes(_initial_plan(df)) if n.nodeName().startswith("Scan")
             and "orders.parquet" in n.simpleString(500)]
    assert len(found) == scans
