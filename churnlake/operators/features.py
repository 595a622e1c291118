"""Feature preparation: exact median / mode imputation, population-std
scaling, one-hot encoding, and the exact-duplicate overlap audit.

Statistics are computed as distributed aggregations over a long
``(column_name, value)`` view so that all columns share one job; only the
fitted per-column scalars (19 numbers) reach the driver, exactly like a
fitted Spark ML model's parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.prefix import running_sums


def long_values(df: DataFrame, columns: list[str], value_type: str = "double") -> DataFrame:
    """(column_name, value) for every non-NULL cell of ``columns``."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(value_type).alias("value"))
                    for c in columns])
    return df.select(F.explode(arr).alias("kv")).select("kv.*").filter(F.col("value").isNotNull())


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Interpolating median per column (numpy/sklearn definition: the mean of
    the two middle values for an even count), NULLs ignored.

    Distributed selection: value counts per (column, value) with partial
    aggregation, running counts in value order (bucketed prefix sums),
    then pick the value(s) covering ranks floor((n+1)/2) and ceil((n+1)/2).
    No value list per column is ever held in one task."""
    vc = long_values(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(vc, "value", ["cnt"], ["column_name"], descending=False)
    n = vc.groupBy("column_name").agg(F.sum("cnt").alias("n"))
    j = cum.join(n, "column_name")
    lo_rank = F.floor((F.col("n") + 1) / 2)
    hi_rank = F.ceil((F.col("n") + 1) / 2)
    first = F.col("cum_cnt") - F.col("cnt") + 1
    covers = lambda r: (first <= r) & (F.col("cum_cnt") >= r)
    picked = j.filter(covers(lo_rank) | covers(hi_rank)).select(
        "column_name",
        F.when(covers(lo_rank), F.col("value")).alias("lo"),
        F.when(covers(hi_rank), F.col("value")).alias("hi"))
    return picked.groupBy("column_name").agg(
        ((F.max("lo") + F.max("hi")) / F.lit(2.0)).alias("median"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-NULL value per column; ties go to the smallest value."""
    vc = (long_values(df, columns, "string").groupBy("column_name", "value")
          .agg(F.count(F.lit(1)).alias("cnt")))
    return vc.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("mode"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation per column, in one pass over the rows."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std"))
        for c in columns])).alias("kv")).select("kv.*")


def _collect_map(stats: DataFrame, value: str) -> dict:
    # per-column scalars (at most one row per feature): bounded.
    return {r["column_name"]: r[value] for r in stats.select("column_name", value).collect()}


def fit_imputer(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    return {"median": _collect_map(exact_medians(train, numeric), "median") if numeric else {},
            "mode": _collect_map(modes(train, categorical), "mode") if categorical else {}}


def apply_imputer(df: DataFrame, params: dict) -> DataFrame:
    out = []
    for c in df.columns:
        if c in params["median"]:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(params["median"][c])).alias(c))
        elif c in params["mode"]:
            out.append(F.coalesce(F.col(c), F.lit(params["mode"][c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_scaler(imputed_train: DataFrame, numeric: list[str]) -> dict:
    st = moments(imputed_train, numeric).collect()
    return {r["column_name"]: (r["mean"], r["std"]) for r in st}


def apply_scaler(df: DataFrame, params: dict) -> DataFrame:
    """(x - mean) / std with a zero std treated as 1 (constant columns)."""
    out = []
    for c in df.columns:
        if c in params:
            mean, std = params[c]
            out.append(((F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def category_index(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Long one-hot view: (id, column_name, category, category_index) where
    the index is the category's position among the sorted training
    categories; unseen or NULL categories get a NULL index (all zeros)."""
    cats = long_values(train, columns, "string").select("column_name", "value").distinct()
    from pyspark.sql import Window
    ranked = cats.withColumn(
        "category_index",
        (F.dense_rank().over(Window.partitionBy("column_name").orderBy("value")) - 1).cast("int"))
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category"))
                    for c in columns])
    lng = df.select("customer_id", F.explode(arr).alias("kv")).select("customer_id", "kv.*")
    # the category table is as large as the categorical domains: no forced
    # broadcast, AQE picks one at run time from its measured size.
    return lng.join(ranked.withColumnRenamed("value", "category"),
                    ["column_name", "category"], "left").select(
        "customer_id", "column_name", "category", "category_index")


def shared_rows(df: DataFrame, split_col: str, pairs: list[tuple[str, str]], columns: list[str] | None = None
                ) -> DataFrame:
    """Distinct feature rows present in both splits of each pair (exact set
    intersection, NULL equals NULL as in SQL INTERSECT): one grouped pass
    marks the splits of every distinct row."""
    from churnlake.schemas import FEATURE_COLUMNS
    cols = columns or FEATURE_COLUMNS
    names = sorted({x for pair in pairs for x in pair})
    seen = df.groupBy(*cols).agg(*[F.max(F.col(split_col) == x).alias(f"_in_{x}") for x in names])
    counts = seen.agg(*[F.count_if(F.col(f"_in_{a}") & F.col(f"_in_{b}")).cast("bigint").alias(f"_{i}")
                        for i, (a, b) in enumerate(pairs)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"_{i}").alias("shared_feature_rows"))
        for i, (a, b) in enumerate(pairs)])).alias("kv")).select("kv.*")
