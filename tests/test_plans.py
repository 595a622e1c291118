"""Plan-shape checks: pushdown, pruning, bounded top-k, no Python UDFs,
fact rows aggregated before every shuffle."""

import pytest

from churnlake.registry import queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_band_filter_reaches_scan(spark):
    """Over a stored prediction table the band filter is a pushed equality."""
    from churnlake.plans import publish, serving
    from churnlake.queries.common import predictions_df
    from churnlake.session import new_table_path
    path = publish.write_prediction_table(predictions_df(spark, SF), new_table_path(spark, "predictions"))
    plan = _plan(serving.customer_list_total(spark.read.parquet(path), "High"))
    assert "PushedFilters: [IsNotNull(risk_band), EqualTo(risk_band,High)]" in plan


def test_page_is_bounded_topk(spark):
    plan = _plan(queries()["customer_list"](spark, SF))
    assert "TakeOrderedAndProject" in plan


def test_fixture_scan_is_pruned(spark):
    from churnlake.queries.common import raw_df
    plan = _plan(raw_df(spark, SF).select("client_num", "total_trans_ct"))
    schemas = [x.split(">")[0] for x in plan.split("ReadSchema: ")[1:]]
    orders = [x for x in schemas if "o_custkey" in x]
    assert orders and all("o_totalprice" not in x and "o_comment" not in x for x in orders)


def test_no_python_udfs_in_registered_sql_queries(spark):
    for name in ["portfolio_summary", "pr_curve", "standard_scale", "customer_details", "cv_summary"]:
        plan = _plan(queries()[name](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


#: Fits and queries that write their results first: their plans are checked where their operators are tested.
ML = {"model_gbt", "model_gbt_xgb", "model_gbt_lgbm", "model_gbt_catboost", "model_gbt_levels", "model_forest",
      "model_extra_trees", "model_tree", "model_tree_nodes", "model_logistic", "logistic_coefficients", "model_knn",
      "benchmark_report", "cv_learners", "champion_test_report", "importance_trained", "model_reload_parity",
      "batch_scoring_model", "model_spark_naive_bayes"}
PLANNED = sorted(set(queries()) - ML)


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_or_python_anywhere(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert not [m for m in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") if m in plan]


# --- hot keys: fact rows never reach a shuffle un-aggregated -------------------

_PASS_THROUGH = ("Project", "Filter", "ColumnarToRow", "InputAdapter", "Union")
_FACTS = ("orders.parquet", "events.parquet")


def _children(node):
    c = node.children()
    return [c.apply(i) for i in range(c.size())]


def _nodes(node):
    yield node
    for k in _children(node):
        yield from _nodes(k)


def _raw_facts_below(node):
    """Fact-table scans that feed ``node`` with no aggregate in between."""
    name = node.nodeName()
    if name.startswith("Scan"):
        return [t for t in _FACTS if t in node.simpleString(200)]
    if name.startswith("WholeStageCodegen") or name in _PASS_THROUGH:
        return [t for k in _children(node) for t in _raw_facts_below(k)]
    return []


def _initial_plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _shuffled_raw_facts(df):
    return [t for n in _nodes(_initial_plan(df)) if n.nodeName() == "Exchange"
            for k in _children(n) for t in _raw_facts_below(k)]


def _scan_below(node) -> bool:
    name = node.nodeName()
    if name.startswith("Scan"):
        return True
    if name.startswith("WholeStageCodegen") or name in _PASS_THROUGH:
        return any(_scan_below(k) for k in _children(node))
    return False


def _broadcast_scans(df):
    """Broadcasts fed straight from a table scan: a table's size grows with
    the data, so only aggregates of bounded groups may be broadcast."""
    return [n.nodeName() for n in _nodes(_initial_plan(df)) if n.nodeName() == "BroadcastExchange"
            and any(_scan_below(k) for k in _children(n))]


@pytest.fixture()
def no_broadcasts(spark):
    """Planned as at scale: no automatic broadcasts, so every join that would shuffle at 100 TB shows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_plan_checks_see_what_they_should(spark, no_broadcasts):
    from pyspark.sql import functions as F
    from churnlake.sources.fixture import read_table
    orders = read_table(spark, SF, "orders")
    # negative controls: the check sees raw shuffles and accepts partial aggregation
    assert _shuffled_raw_facts(orders.repartition("o_custkey")) == ["orders.parquet"]
    assert _shuffled_raw_facts(orders.groupBy("o_custkey").count()) == []
    assert _broadcast_scans(orders.join(F.broadcast(orders.select("o_custkey")), "o_custkey"))


@pytest.mark.parametrize("name", PLANNED)
def test_fact_rows_are_aggregated_before_every_shuffle(spark, no_broadcasts, name):
    """A customer holding a third of all orders must reach each shuffle as
    one pre-aggregated row per task, and only aggregated, bounded tables are
    broadcast."""
    df = queries()[name](spark, SF)
    assert _shuffled_raw_facts(df) == []
    assert not _broadcast_scans(df)
