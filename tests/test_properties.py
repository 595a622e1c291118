"""Property tests: distributed metrics equal brute force on random frames."""

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from churnlake.operators import metrics as M
from churnlake.operators.prefix import running_sums


def _brute_ap_auc(rows):
    pos = sum(1 for y, _ in rows if y == 1)
    neg = len(rows) - pos
    thresholds = sorted({s for _, s in rows}, reverse=True)
    ap, prev_recall = 0.0, 0.0
    for t in thresholds:
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        n = sum(1 for _, s in rows if s >= t)
        recall = tp / pos
        ap += (recall - prev_recall) * (tp / n)
        prev_recall = recall
    pairs = sum((1.0 if sp > sn else 0.5 if sp == sn else 0.0)
                for yp, sp in rows if yp == 1 for yn, sn in rows if yn == 0)
    return ap, pairs / (pos * neg)


rows_strategy = st.lists(
    st.tuples(st.integers(0, 1), st.integers(0, 20).map(lambda k: k / 20.0)), min_size=4, max_size=60
).filter(lambda r: 0 < sum(y for y, _ in r) < len(r))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(rows=rows_strategy, buckets=st.integers(1, 9))
def test_ap_auc_match_brute_force(spark, rows, buckets):
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.ranking_metrics(M.pr_table(df, buckets=buckets)).collect()[0]
    ap, auc = _brute_ap_auc(rows)
    assert abs(got.average_precision - ap) < 1e-9
    assert abs(got.roc_auc - auc) < 1e-9


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50), st.integers(1, 9)),
                       min_size=1, max_size=50, unique_by=lambda t: (t[0], t[1])),
       buckets=st.integers(1, 7), descending=st.booleans())
def test_grouped_running_sums_match_brute_force(spark, values, buckets, descending):
    df = spark.createDataFrame(values, "g string, v long, c long")
    got = {(r.g, r.v): r.cum_c for r in running_sums(df, "v", ["c"], ["g"], descending, buckets=buckets).collect()}
    for g, v, _ in values:
        want = sum(c for g2, v2, c in values if g2 == g and ((v2 >= v) if descending else (v2 <= v)))
        assert got[(g, v)] == want
