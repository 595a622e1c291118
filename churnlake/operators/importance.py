"""Permutation importance as one distributed job.

A repeat permutes the evaluation rows once, and all features share that
permutation: rows are numbered in a base hash order and, per repeat, in a
salted hash order; the row at base position i takes its donor values from
the row at permuted position i. Positions come from the distributed
``dense_positions`` (no single-partition window). Each row joins its donor
once per repeat, so the shuffle carries ``repeats`` copies of the rows; the
scores with one feature replaced each stand side by side in that row, and
(feature, repeat, label, score) counts leave the map side pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import hash_unit
from churnlake.operators.metrics import pr_table, ranking_metrics, score_bounds
from churnlake.operators.prefix import dense_positions, materialize, running_sums

Scorer = Callable[[dict[str, Column]], Column]


def _perm_hash(seed: int):
    text = F.concat(F.lit(f"perm:{seed}:"), F.col("repeat").cast("string"),
                    F.lit(":"), F.col("customer_id").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def permutation_importance(rows: DataFrame, scorer: Scorer, features: list[str], repeats: int = 10,
                           seed: int = 42, label: str = "churn_flag") -> DataFrame:
    """(feature, importance_mean, importance_std) of the average-precision
    drop. ``scorer`` maps {feature: Column} to the score Column of a fitted
    model or a fixed formula."""
    v = materialize(rows.select("customer_id", F.col(label).alias("label"), *features))
    base_scores = materialize(v.select("label", scorer({f: F.col(f) for f in features}).alias("score")))
    bounds = score_bounds(base_scores)  # permutations keep the score domain's range
    base_ap = ranking_metrics(pr_table(base_scores, bounds=bounds)).select("average_precision").scalar()

    based = v.withColumn("_hb", hash_unit(f"perm-base:{seed}:", "customer_id"))
    base = dense_positions(based, ["_hb", "customer_id"], bucket_col="_hb").drop("_hb")
    donors = v.select("customer_id", F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("repeat"),
                      *[F.col(f).alias(f"_d_{f}") for f in features])
    donors = donors.withColumn("_hp", _perm_hash(seed))
    donors = dense_positions(donors, ["_hp", "customer_id"], ["repeat"], bucket_col="_hp")
    perm = base.join(donors.select("repeat", "position", *[f"_d_{f}" for f in features]), "position")
    scores = F.array(*[F.struct(F.lit(f).alias("feature"), scorer(
        {g: F.col(f"_d_{g}" if g == f else g) for g in features}).alias("score")) for f in features])
    scored = perm.select("repeat", "label", F.explode(scores).alias("s")).select(
        "s.feature", "repeat", "label", "s.score")
    ap = ranking_metrics(pr_table(scored, group_cols=["feature", "repeat"], bounds=bounds), ["feature", "repeat"])
    drops = ap.select("feature", (base_ap - F.col("average_precision")).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                        F.stddev_pop("drop").alias("importance_std"))


def model_importance(binned: DataFrame, groups: dict[str, list[int]], score: Callable, repeats: int = 10,
                     seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std) for a fitted model over binned rows.

    ``binned`` (customer_id, label, bins); ``groups`` names the places in
    ``bins`` that belong to a feature (a category has several); ``score`` maps
    a matrix of bins to scores, and travels to the tasks once (one with a method
    ``replaced``, as ``boosting.Scorer``, scores all replacements of a batch itself). Each row meets
    its donor once per repeat, the task scores it with one feature after
    another replaced, and counts by (feature, repeat, score, label) leave the
    task added up: one pass for all features and repeats.
    """
    import numpy as np
    import pyarrow as pa
    spark = binned.sparkSession
    v = materialize(binned.select("customer_id", F.col("label").cast("long").alias("label"), "bins"))
    shared = spark.sparkContext.broadcast((groups, score))

    def matrix(column, rows):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    def plain(batches):
        for b in batches:
            s = shared.value[1](matrix(b.column(1), b.num_rows)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["label", "score"])

    def one_by_one(own, donor, groups):
        for name, places in groups.items():
            mixed = own.copy()
            mixed[:, places] = donor[:, places]
            yield name, shared.value[1](mixed)

    def replaced(batches):
        groups, score = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own, donor = matrix(b.column(2), b.num_rows), matrix(b.column(3), b.num_rows)
            for name, scores in (score.replaced if hasattr(score, "replaced") else one_by_one)(own, donor, groups):
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), b.column(0), b.column(1),
                                                  pa.array(scores)], ["feature", "repeat", "label", "score"])

    base_scores = materialize(v.select("label", "bins").mapInArrow(plain, "label long, score double"))
    base_ap = ranking_metrics(pr_table(base_scores)).select("average_precision").scalar()
    base = dense_positions(v.withColumn("_hb", hash_unit(f"perm-base:{seed}:", "customer_id")), ["_hb", "customer_id"],
                           bucket_col="_hb").drop("_hb")
    donors = v.select("customer_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"),
                      F.col("bins").alias("donor")).withColumn("_hp", _perm_hash(seed))
    donors = dense_positions(donors, ["_hp", "customer_id"], ["repeat"], bucket_col="_hp")
    pairs = base.join(donors.select("repeat", "position", "donor"), "position").select("repeat", "label", "bins", "donor")
    scored = materialize(pairs.mapInArrow(replaced, "feature string, repeat int, label long, score double")
                         .groupBy("feature", "repeat", "score").agg(
                             F.count(F.lit(1)).alias("n"), F.sum("label").alias("tp")))
    cum = running_sums(scored, "score", ["n", "tp"], ["feature", "repeat"], descending=True, with_totals=True)
    ap = cum.groupBy("feature", "repeat").agg(F.sum(
        F.col("tp") / F.nullif(F.col("total_tp"), F.lit(0)) * F.col("cum_tp") / F.col("cum_n")).alias("ap"))
    return ap.select("feature", (base_ap - F.col("ap")).alias("drop")).groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
