"""The benchmark ranks every kind of learner, and each boosted preset is a query."""

import pytest

from churnlake.operators import boosting, learners
from churnlake.registry import oracle_sql, queries


def test_boosted_presets_are_ranked_and_registered():
    boosted = set(boosting.PRESETS)
    assert len(boosted) == 4 and boosted <= set(learners.LEARNERS)
    names = {"model_gbt", "model_gbt_xgb", "model_gbt_lgbm", "model_gbt_catboost", "model_extra_trees"}
    assert names <= set(queries()) and names <= set(oracle_sql())


@pytest.fixture(scope="module")
def split(spark, sf_small):
    from churnlake.queries.learners import _labelled
    return _labelled(spark, sf_small)


def test_benchmark_ranks_what_could_be_fitted(split, monkeypatch):
    monkeypatch.setitem(learners.SINGLE, "knn", lambda p: 1 / 0)
    report, scores = learners.benchmark(split, ["knn", "logistic_regression", "gaussian_nb"])
    rows = {r["model"]: r for r in report.collect()}
    assert set(rows) == {"prior", "knn", "logistic_regression", "gaussian_nb"}
    assert rows["knn"].error.startswith("ZeroDivisionError") and rows["knn"].average_precision is None
    assert rows["prior"].roc_auc == 0.5 and rows["logistic_regression"].error is None
    assert learners.champion(report) in ("logistic_regression", "gaussian_nb")
    assert scores.where("model = 'knn'").isEmpty()


def test_folds_score_every_row_once(split):
    from churnlake.operators.learners import cross_validate
    dev = split.where("split in ('train', 'validation')").drop("split", "position")
    rows = cross_validate(dev, ["gaussian_nb", "decision_tree"], 3).collect()
    ids = sorted(r.customer_id for r in dev.collect())
    for model in ("gaussian_nb", "decision_tree"):
        assert sorted(r.customer_id for r in rows if r.model == model) == ids


def test_vector_naive_bayes_equals_the_counted_one(split):
    from churnlake.operators import binning, naive_bayes
    prepared = learners.prepare(binning.single_fit(split))
    got = {r.customer_id: r.score for r in naive_bayes.score_vectors(prepared.vectors, len(prepared.prep.names)).collect()}
    model = naive_bayes.fit(split.where("split = 'train'"), "label")
    want = {r.customer_id: r.score for r in naive_bayes.predict(model, split.where("split = 'validation'"), "label").collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-7) for i in want)


def test_constant_scores_turn_the_checks_false(spark, split):
    from pyspark.sql import functions as F
    from churnlake.queries.learners import _checked
    rows = split.select("customer_id", (F.col("split") == "train").alias("train"), "label", F.lit(0.3).alias("score"))
    row = _checked(rows).first()
    assert not row.scores_differ and not row.beats_prior_on_train


def test_boosted_scores_of_batches_that_hold_one_fit_only(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(f, True, i, int(i % 3 == 0), rng.integers(0, 4, 3).tolist()) for f in (0, 1) for i in range(200)]
    frame = spark.createDataFrame(rows, "fit int, train boolean, customer_id long, label int, bins array<tinyint>") \
        .repartition(2, "fit").sortWithinPartitions("fit")
    settings = learners.G.BoostSettings(rounds=2, leaves=3, min_rows=8, bins=4)
    made = learners.G.fit_boosters(frame, 3, {"a": settings, "b": settings})
    got = learners.G.predict_boosters(made, frame, "customer_id").groupBy("preset", "fit").count().collect()
    assert sorted(map(tuple, got)) == [(n, f, 200) for n in "ab" for f in (0, 1)]


def test_folds_are_fitted_one_after_another_by_a_forest(spark, monkeypatch):
    seen, fit = [], learners.T.fit_forest
    monkeypatch.setattr(learners.T, "fit_forest", lambda rows, n, s, fits: seen.append(fits) or fit(rows, n, s, fits))
    monkeypatch.setitem(learners.FORESTS, "random_forest", learners.T.TreeSettings(trees=2, max_depth=2, min_leaf=3, bins=4))
    rows = [(f, i % 2 == f, i, int(i % 3 == 0), [i % 4, i // 50]) for f in (0, 1) for i in range(200)]
    binned = spark.createDataFrame(rows, "fit int, train boolean, customer_id long, label int, bins array<tinyint>")
    prep = learners.B.Preparation({0: {}, 1: {}}, {}, {}, {}, {}, ["a", "b"])
    scored = learners._forest("random_forest")(learners.Prepared(prep, binned, binned)).collect()
    assert seen == [[0], [1]] and len(scored) == 200
