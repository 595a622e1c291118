"""Ordered target statistics: a category as the label's mean over the rows that come earlier in a permutation.

A row's own label, and those of later rows, never enter its feature, so the
feature doesn't leak the label that a tree is fitted to. The permutation is a
hash order of the keys; counts and sums before a row are distributed prefix
sums by (column, category), so a category that holds a third of all rows is
spread over many tasks. Rows to be scored take the statistics of all training
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import hash_unit
from churnlake.operators.prefix import join_on_groups, materialize, sums_before

SALT = "target-statistics:"


def _long(df: DataFrame, columns: list[str], *keep) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("kv")).select(*[k for k in df.columns if k in keep], "kv.*")


def ordered_statistics(train: DataFrame, columns: list[str], label: str = "label", key: str = "customer_id",
                       weight: float = 1.0) -> DataFrame:
    """(key, column_name, category, statistic) of the training rows.

    statistic = (labels of earlier rows of the category + weight * prior) /
    (number of these rows + weight), with the mean label as prior; earlier is
    by (hash, key). A NULL category is one like any other; rows without a
    label are left out.
    """
    rows = materialize(train.where(F.col(label).isNotNull()).select(key, F.col(label).cast("long").alias("_y"), *columns)
                       .withColumn("_h", hash_unit(SALT, key)).withColumn("_one", F.lit(1)))
    prior = rows.agg(F.avg("_y")).scalar()
    cells = _long(rows, columns, key, "_y", "_h", "_one")
    sums = sums_before(cells, ["_h", key], ["_y", "_one"], ["column_name", "category"], "_h")
    return sums.select(key, "column_name", "category",
                       ((F.col("before__y") + weight * prior) / (F.col("before__one") + weight)).alias("statistic"))


def scoring_statistics(train: DataFrame, target: DataFrame, columns: list[str], label: str = "label",
                       key: str = "customer_id", weight: float = 1.0) -> DataFrame:
    """The same of ``target`` rows, from all training rows; a category that training never saw has the prior."""
    rows = materialize(train.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("_y"), *columns))
    prior = rows.agg(F.avg("_y")).scalar()
    known = _long(rows, columns, "_y").groupBy("column_name", "category").agg(
        F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
    cells = _long(target.select(key, *columns), columns, key)
    joined = join_on_groups(cells, known, ["column_name", "category"], "left")
    return joined.select(key, "column_name", "category", (
        (F.coalesce("s", F.lit(0)) + weight * prior) / (F.coalesce("n", F.lit(0)) + weight)).alias("statistic"))
