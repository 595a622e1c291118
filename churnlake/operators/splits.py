"""Deterministic splits: hash split, exact stratified split, stratified k-fold.

Assignment is a pure function of the customer id and a salt (md5-based
``hash_unit``), so it is reproducible across runs, engines and cluster
sizes, and needs no shuffle for the hash variant. Exact-count variants
rank rows within each label by the hash with the distributed
``prefix.dense_positions`` (never a single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import hash_bucket, hash_unit
from churnlake.operators.prefix import dense_positions, join_on_groups

SPLIT_SALT = "42:"
SCORE_SALT = "score:"
SPLITS = ["train", "validation", "test"]


def hash_split(df: DataFrame, key: str = "customer_id", salt: str = SPLIT_SALT) -> DataFrame:
    """60/20/20 by hash bucket: 0-1 test, 2-3 validation, 4-9 train."""
    b = hash_bucket(salt, key, 10)
    return df.withColumn("split", F.when(b < 2, F.lit("test")).when(b < 4, F.lit("validation"))
                         .otherwise(F.lit("train")))


def stratified_positions(df: DataFrame, label: str = "churn_flag", key: str = "customer_id",
                         salt: str = SPLIT_SALT) -> DataFrame:
    """1-based position of each row within its label in (hash, key) order,
    plus the label size. Rows without a label are a stratum of their own."""
    h = df.withColumn("_h", hash_unit(salt, key))
    pos = dense_positions(h, ["_h", key], [label], bucket_col="_h")
    sizes = h.groupBy(label).agg(F.count(F.lit(1)).alias("_label_rows"))
    return join_on_groups(pos, sizes, [label]).drop("_h")


def exact_stratified_split(df: DataFrame, test: float = 0.2, validation: float = 0.2,
                           label: str = "churn_flag", key: str = "customer_id",
                           salt: str = SPLIT_SALT) -> DataFrame:
    """Per label: the first ceil(test*n) positions are test, the next up to
    ceil((test+validation)*n) validation, the rest train (exact quotas)."""
    p = stratified_positions(df, label, key, salt)
    n = F.col("_label_rows")
    cut_test = F.ceil(n * F.lit(test))
    cut_val = F.ceil(n * F.lit(test + validation))
    split = (F.when(F.col("position") <= cut_test, F.lit("test"))
             .when(F.col("position") <= cut_val, F.lit("validation")).otherwise(F.lit("train")))
    return p.withColumn("split", split).drop("_label_rows")


def kfold_assign(df: DataFrame, k: int = 5, label: str = "churn_flag", key: str = "customer_id",
                 salt: str = SPLIT_SALT) -> DataFrame:
    """Stratified k folds: fold = (position within label - 1) mod k."""
    p = stratified_positions(df, label, key, salt)
    return p.withColumn("fold", F.pmod(F.col("position") - 1, F.lit(k)).cast("int")).drop("_label_rows")


def labelled_scores(mart: DataFrame, key: str = "customer_id", label: str = "churn_flag") -> DataFrame:
    """An informative score in integer thousandths (with ties) for metric and
    threshold queries: churners get (2000 + 8u + 5) div 10, others
    (6u^2 + 5000) div 10000, with u = hash_unit('score:', id) mod 1000."""
    u = F.pmod(hash_unit(SCORE_SALT, key), F.lit(1000))
    pos = F.floor((F.lit(2000) + F.lit(8) * u + F.lit(5)) / F.lit(10))
    neg = F.floor((F.lit(6) * u * u + F.lit(5000)) / F.lit(10000))
    k = F.when(F.col(label) == 1, pos).otherwise(neg).cast("bigint")
    return mart.select(key, F.col(label).alias("label"), k.alias("score_k"),
                       (k.cast("double") / F.lit(1000.0)).alias("score"))
