"""Gaussian naive Bayes as DataFrame jobs.

Features follow the reference's preprocessing: numeric -> exact median
imputation -> standard scaling (population std); categorical ->
most-frequent imputation -> one indicator per training category (unknown ->
all zeros). An indicator's class mean and variance follow from counts, so
no indicator is ever built: the fit is one wide aggregate over the numeric
columns and one grouped count of (class, column, value). Per class and
column, the log-likelihood of "all indicators zero" is one number, and a
category adds a difference kept in a parameter table, joined by value (its
size is that of the category domain, so Spark sizes the join). Variance
smoothing is 1e-9 x the largest feature variance. Rows without a label
teach nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import features as FT
from churnlake.operators.prefix import materialize
from churnlake.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

VAR_SMOOTHING = 1e-9


def _numeric(imputer: dict, scaler: dict, values=F.col) -> dict[str, F.Column]:
    """Imputed and scaled numeric features."""
    out = {}
    for c in NUMERIC_FEATURES:
        mean, std = scaler[c]
        out[c] = (F.coalesce(values(c).cast("double"), F.lit(imputer["median"][c])) - F.lit(mean)) / F.lit(std or 1.0)
    return out


def _log_density(x, mean, var):
    return F.lit(-0.5) * F.log(F.lit(2.0 * math.pi) * var) - (x - mean) * (x - mean) / (F.lit(2.0) * var)


def fit(train: DataFrame, label: str = "churn_flag") -> dict:
    rows = materialize(train.select(label, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES).filter(F.col(label).isNotNull()))
    imputer = FT.fit_imputer(rows, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    scaler = FT.fit_scaler(FT.apply_imputer(rows.select(*NUMERIC_FEATURES), imputer), NUMERIC_FEATURES)
    x = _numeric(imputer, scaler)
    # classes x numeric features numbers: bounded
    stats = {r["cls"]: r for r in rows.groupBy(F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m_{c}") for c, v in x.items()],
        *[F.var_pop(v).alias(f"v_{c}") for c, v in x.items()]).collect()}
    classes = sorted(stats)
    total = sum(r["n"] for r in stats.values())
    largest = 0.0
    for c in NUMERIC_FEATURES:  # overall variance by the law of total variance
        mean = sum(r["n"] * r[f"m_{c}"] for r in stats.values()) / total
        largest = max(largest, sum(r["n"] * (r[f"v_{c}"] + (r[f"m_{c}"] - mean) ** 2) for r in stats.values()) / total)
    imputed = FT.apply_imputer(rows.select(label, *CATEGORICAL_FEATURES), imputer)
    counts = imputed.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in CATEGORICAL_FEATURES])).alias("kv")) \
        .groupBy("kv.column_name", "kv.value").agg(
            *[F.count_if(F.col(label) == k).cast("double").alias(f"n_{k}") for k in classes])
    counts = materialize(counts.filter(F.col("value").isNotNull()))
    p_all = sum((F.col(f"n_{k}") for k in classes), F.lit(0.0)) / F.lit(float(total))
    widest = counts.agg(F.max(p_all * (1 - p_all))).first()[0] or 0.0
    eps = VAR_SMOOTHING * max(largest, widest)

    def terms(k):
        p = F.col(f"n_{k}") / F.lit(float(stats[k]["n"]))
        var = p * (1 - p) + F.lit(eps)
        zero = _log_density(F.lit(0.0), p, var)
        return zero, _log_density(F.lit(1.0), p, var) - zero

    zeros = {r["column_name"]: r for r in counts.groupBy("column_name").agg(
        *[F.sum(terms(k)[0]).alias(f"z_{k}") for k in classes]).collect()}  # one row per column
    return {"imputer": imputer, "scaler": scaler, "classes": classes, "epsilon": eps,
            "log_prior": {k: math.log(stats[k]["n"] / total) for k in classes},
            "numeric": {k: {c: (stats[k][f"m_{c}"], stats[k][f"v_{c}"] + eps) for c in NUMERIC_FEATURES}
                        for k in classes},
            "zeros": {k: sum(z[f"z_{k}"] for z in zeros.values()) for k in classes},
            "categories": counts.select("column_name", "value", *[terms(k)[1].alias(f"d_{k}") for k in classes])}


def joint_log_likelihood(model: dict, df: DataFrame, keep: list) -> DataFrame:
    """``keep`` columns and ``_j<class>``: log prior + log likelihood per class."""
    out = FT.apply_imputer(df, {"median": {}, "mode": model["imputer"]["mode"]})
    for c in CATEGORICAL_FEATURES:
        part = model["categories"].filter(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), *[F.col(f"d_{k}").alias(f"_d_{c}_{k}") for k in model["classes"]])
        out = out.join(part, F.col(c) == F.col(f"_v_{c}"), "left")
    x = _numeric(model["imputer"], model["scaler"])
    joint = []
    for k in model["classes"]:
        expr = F.lit(model["log_prior"][k] + model["zeros"][k])
        for c, (mean, var) in model["numeric"][k].items():
            expr = expr + (F.lit(-0.5 * math.log(2.0 * math.pi * var))
                           - (x[c] - F.lit(mean)) * (x[c] - F.lit(mean)) / F.lit(2.0 * var))
        for c in CATEGORICAL_FEATURES:
            expr = expr + F.coalesce(F.col(f"_d_{c}_{k}"), F.lit(0.0))
        joint.append(expr.alias(f"_j{k}"))
    return out.select(*keep, *joint)


def predict(model: dict, df: DataFrame, label: str = "churn_flag") -> DataFrame:
    """customer_id, label, score = P(class 1), prediction = argmax (ties -> 0)."""
    if model["classes"] != [0, 1]:
        raise ValueError(f"binary 0/1 labels expected, got {model['classes']}")
    out = joint_log_likelihood(model, df, ["customer_id", F.col(label).alias("label")])
    return out.select("customer_id", "label",
                      (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_j0") - F.col("_j1")))).alias("score"),
                      (F.col("_j1") > F.col("_j0")).cast("int").alias("prediction"))


def score_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(fit, customer_id, label, score) of rows that don't train, for all fits: one grouped pass, one expression.

    ``vectors`` (fit, train, customer_id, label, x) holds scaled numbers and
    indicators; the same model as ``fit`` and ``predict``, whose indicators
    are counted and not built.
    """
    sums = vectors.where("train").groupBy("fit", "label").agg(
        F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(F.col("x")[i]), F.var_pop(F.col("x")[i])).alias(f"x{i}")
                                        for i in range(width)]).collect()  # two rows a fit
    model: dict[int, dict] = {}
    for r in sums:
        model.setdefault(r["fit"], {})[r["label"]] = (r["n"], [tuple(r[f"x{i}"]) for i in range(width)])
    out = None
    for fit, classes in sorted(model.items()):
        total = sum(n for n, _ in classes.values())
        mean = [sum(n * m[i][0] for n, m in classes.values()) / total for i in range(width)]
        widest = max(sum(n * (m[i][1] + (m[i][0] - mean[i]) ** 2) for n, m in classes.values()) / total for i in range(width))
        joint = {}
        for label, (n, m) in classes.items():
            var = [v + VAR_SMOOTHING * widest for _, v in m]
            constant = math.log(n / total) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in var)
            parts = F.zip_with("x", F.array(*[F.struct(F.lit(mu), F.lit(v)) for (mu, _), v in zip(m, var)]),
                               lambda a, p: (a - p["col1"]) * (a - p["col1"]) / (2 * p["col2"]))
            joint[label] = F.aggregate(parts, F.lit(constant), lambda s, q: s - q)
        score = 1 / (1 + F.exp(joint[0] - joint[1])) if len(joint) == 2 else F.lit(float(next(iter(joint))))
        out = F.when(F.col("fit") == fit, score) if out is None else out.when(F.col("fit") == fit, score)
    return vectors.where("not train").select("fit", "customer_id", "label", out.alias("score"))
