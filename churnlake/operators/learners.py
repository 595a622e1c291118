"""The learners side by side: prepared once, fitted for one split or for all folds together, ranked, refitted.

Rows come as (fit, train, customer_id, label, features), see
``binning.single_fit`` and ``binning.fold_fits``. They are prepared once for
all learners (medians, modes, scaling, bins: grouped passes over the training
rows of every fit) and written as bins and as vectors. Each learner then fits
all fits in its own passes and its scores are written, so a report never
fits again. A learner that fails is recorded and the others go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import binning as B
from churnlake.operators import boosting as G
from churnlake.operators import features as FT
from churnlake.operators import forest as T
from churnlake.operators import logistic as R
from churnlake.operators.prefix import materialize
from churnlake.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

#: The square root of 14 numeric features and some 20 categories is 5 or 6.
FORESTS = {
    "decision_tree": T.TreeSettings(trees=1, max_depth=8, min_leaf=20),
    "random_forest": T.TreeSettings(trees=250, max_depth=12, min_leaf=3, features=6, bootstrap=True),
    "extra_trees": T.TreeSettings(trees=250, max_depth=12, min_leaf=3, features=6, random_cut=True, seed=43),
}
LEARNERS = ["logistic_regression", "knn", "gaussian_nb", *FORESTS, *G.PRESETS]


@dataclass
class Prepared:
    """Written bins and vectors of all fits."""

    prep: B.Preparation
    binned: DataFrame
    vectors: DataFrame


def prepare(rows: DataFrame) -> Prepared:
    """``rows`` (fit, train, customer_id, label, features) with their labels known."""
    rows = materialize(rows.where("label is not null"))
    prep = B.fit_preparation(rows)
    keep = [F.col("fit").cast("int").alias("fit"), "train", "customer_id", F.col("label").cast("int").alias("label")]
    # rows lie by fit in each file, so that a reader of one fit skips the pages of the others
    return Prepared(prep, *(materialize(made(rows, *keep).sortWithinPartitions("fit")) for made in (prep.binned, prep.vectors)))


def _logistic(p: Prepared) -> DataFrame:
    beta = R.fit_logistic(p.vectors, p.prep.fits, len(p.prep.names))
    return R.predict_logistic(beta, p.vectors.where("not train"), "fit", "customer_id", "label")


def _knn(p: Prepared) -> DataFrame:
    from churnlake.operators.neighbours import predict_neighbours
    return predict_neighbours(p.vectors)


def _gaussian_nb(p: Prepared) -> DataFrame:
    from churnlake.operators.naive_bayes import score_vectors
    return score_vectors(p.vectors, len(p.prep.names))


def _forest(name: str) -> Callable[[Prepared], DataFrame]:
    def run(p: Prepared) -> DataFrame:
        scored = []
        for f in p.prep.fits:  # the driver holds the trees of one fit
            own = p.binned.where(F.col("fit") == f)
            forest = T.fit_forest(own, len(p.prep.names), FORESTS[name], [f])
            scored.append(materialize(T.predict_forest(forest, own.where("not train"), "customer_id", "label")))
        return reduce(DataFrame.unionByName, scored)
    return run


SINGLE = {"logistic_regression": _logistic, "knn": _knn, "gaussian_nb": _gaussian_nb, **{n: _forest(n) for n in FORESTS}}


def _boosted(p: Prepared, names: list[str]) -> DataFrame:
    made = G.fit_boosters(p.binned, len(p.prep.names), {n: G.PRESETS[n] for n in names})
    return G.predict_boosters(made, p.binned.where("not train"), "customer_id", "label")


def score_learners(prepared: Prepared, names: list[str], at_once: int = 3) -> tuple[DataFrame, dict, dict]:
    """(scores (model, fit, customer_id, label, score), seconds and errors by name) of the rows that don't train.

    Boosted learners share their passes; the others run ``at_once`` at a time,
    so that one learner's short jobs fill the gaps of another's.
    """
    columns = ["model", "fit", "customer_id", "label", "score"]
    boosted = [n for n in names if n in G.PRESETS]
    work = {n: [n] for n in names if n not in G.PRESETS} | ({"boosted": boosted} if boosted else {})

    def run(key):
        start = time.time()
        try:
            if key == "boosted":
                scored = _boosted(prepared, boosted).withColumnRenamed("preset", "model")
            else:
                scored = SINGLE[key](prepared).withColumn("model", F.lit(key))
            return materialize(scored.select(*columns)), time.time() - start, None
        except Exception as exc:  # noqa: BLE001  (keep going, as the reference does)
            return None, time.time() - start, f"{type(exc).__name__}: {exc}"

    with ThreadPoolExecutor(at_once) as pool:
        done = dict(zip(work, pool.map(run, work)))
    seconds = {n: done[k][1] / len(work[k]) for k in work for n in work[k]}
    errors = {n: done[k][2] for k in work for n in work[k] if done[k][2] is not None}
    out = None
    for scored, _, _ in done.values():
        if scored is not None:
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise RuntimeError(f"no learner could be fitted: {errors}")
    return out, seconds, errors


def prior_scores(train: DataFrame, target: DataFrame, label: str = "churn_flag") -> DataFrame:
    """Constant score = training churn rate (a scalar subquery, no join)."""
    prior = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return target.select("customer_id", F.col(label).alias("label"), prior.alias("score"))


def benchmark(split: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, scores): each learner fitted on train and scored on validation, with the prior's constant beside them.

    ``split`` has customer_id, label, split and the features. The report has
    one row per learner: its metrics, seconds and error (metrics are null
    where it failed).
    """
    from churnlake.operators.metrics import evaluate_predictions
    names = list(names or LEARNERS)
    prepared = prepare(B.single_fit(split))
    scores, seconds, errors = score_learners(prepared, names)
    rows = prepared.binned
    prior = prior_scores(rows.where("train"), rows.where("not train"), "label") \
        .select(F.lit("prior").alias("model"), F.lit(0).alias("fit"), "customer_id", "label", "score")
    scores = scores.unionByName(prior)
    metrics = evaluate_predictions(scores, 0.5, group_cols=["model"])
    runs = split.sparkSession.createDataFrame(
        [(n, float(seconds.get(n, 0.0)), errors.get(n)) for n in ["prior", *names]],
        "model string, fit_seconds double, error string")
    return runs.join(metrics, "model", "left"), scores


def cross_validate(dev: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """(model, fold, customer_id, label, score): out-of-fold scores with refits, preparation included.

    All folds of a learner are fitted in the same passes.
    """
    from churnlake.operators.splits import kfold_assign
    folds = kfold_assign(dev, k, label="label")
    scores, _, errors = score_learners(prepare(B.fold_fits(folds, k)), names)
    if errors:
        raise RuntimeError(f"learners that failed: {errors}")
    return scores.withColumnRenamed("fit", "fold")


def champion(report: DataFrame) -> str:
    """The learner of the largest average precision (then ROC AUC, then name)."""
    from churnlake.plans.evaluation import rank_models
    ranked = rank_models(report.where("model <> 'prior' and average_precision is not null"))
    return ranked.where("ranking = 1").first()["model"]


def _dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _txt(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Preprocessor:
    """The preparation as a Spark ML ``PipelineModel`` (a ``SQLTransformer``
    carrying the fitted medians, modes, means and population stds as
    literals, then StringIndexer / OneHotEncoder / VectorAssembler), so that
    preprocessing + classifier save and load as one model."""

    def __init__(self, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, train: DataFrame) -> "Preprocessor":
        from pyspark.ml.feature import SQLTransformer
        # several statistics passes read the training rows: materialise once.
        rows = materialize(train.select(*self.numeric, *self.categorical))
        self.imputer = FT.fit_imputer(rows, self.numeric, self.categorical)
        imputed = FT.apply_imputer(rows, self.imputer)
        self.scaler = FT.fit_scaler(imputed, self.numeric)
        exprs = []
        for c in self.numeric:
            mean, std = self.scaler[c]
            med = self.imputer["median"][c]
            exprs.append(f"(coalesce(CAST(`{c}` AS DOUBLE), {_dbl(med)}) - {_dbl(mean)}) / "
                         f"{_dbl(std if std else 1.0)} AS `{c}__prep`")
        for c in self.categorical:
            exprs.append(f"coalesce(`{c}`, {_txt(self.imputer['mode'][c])}) AS `{c}__prep`")
        stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
        onehot_cols = [f"{c}__oh" for c in self.categorical]
        if self.categorical:  # one indexer for all columns: a single fitting pass
            stages.append(StringIndexer(inputCols=[f"{c}__prep" for c in self.categorical],
                                        outputCols=[f"{c}__idx" for c in self.categorical],
                                        handleInvalid="keep", stringOrderType="alphabetAsc"))
            # the indexer keeps one more index for unseen values; as the last one it is dropped, so they are all zeros
            stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in self.categorical],
                                        outputCols=onehot_cols, dropLast=True, handleInvalid="error"))
        stages.append(VectorAssembler(inputCols=[f"{c}__prep" for c in self.numeric] + onehot_cols,
                                      outputCol="features"))
        self.pipeline = Pipeline(stages=stages).fit(train)
        seen = [len(labels) for labels in self.pipeline.stages[1].labelsArray] if self.categorical else []
        self.width = len(self.numeric) + sum(seen)  # one indicator per training category, none for unseen ones
        return self

    def transform(self, df: DataFrame, label: str = "churn_flag") -> DataFrame:
        out = self.pipeline.transform(df)
        return out.select("customer_id", F.col(label).cast("double").alias("label"), "features")

    def with_model(self, model):
        """Preprocessing + a fitted classifier as one PipelineModel."""
        from pyspark.ml import PipelineModel
        return PipelineModel(stages=list(self.pipeline.stages) + [model])


def saved_logistic(n_train: int) -> LogisticRegression:
    """Spark ML's own logistic regression with the same penalty, for a pipeline that is saved and loaded."""
    return LogisticRegression(maxIter=2000, tol=1e-10, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                              standardization=False)
