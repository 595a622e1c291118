"""Running totals in score order without a global single-partition window.

``Window.orderBy(score)`` with no partition key pulls every row into one
task. Instead:

1. take ``k - 1`` approximate quantile boundaries of the ordering column
   once (a bounded list of scalars), and freeze them as one array literal;
2. bucket = number of boundaries on the far side of the value (a binary
   search), so bucket 0 holds the first values in the requested order;
3. per (group, bucket) totals -> a prefix over buckets on that small table
   (``groups x k`` rows) -> joined back as offsets (Spark sizes the join);
4. the running total inside each (group, bucket) is an ordinary
   partitioned window, plus the offset.

The result is exact whatever the boundaries are; the boundaries only
decide how evenly the work spreads. Input must already hold one row per
(group, ordering value) — aggregate ties first. A NULL group is a group like
any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def default_buckets(df: DataFrame) -> int:
    """Two buckets per shuffle partition, so a ranking spreads over the whole cluster."""
    return max(1, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def join_on_groups(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL matches NULL; the columns are kept once."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in cols else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(F.col(f"_right_{c}")) for c in cols]
    return left.join(other, on, how).drop(*[f"_right_{c}" for c in cols])


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the frame as a Parquet table in the shared
    folder (``spark.checkpoint.dir``) and reading it back: one upstream
    computation (an eager reliable ``checkpoint()`` would compute an
    uncached plan twice), and later passes get column pruning and file
    statistics. Survives executor loss like any committed table."""
    from churnlake.session import new_table_path
    path = new_table_path(df.sparkSession, "stage")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_boundaries(df: DataFrame, order_col: str, buckets: int) -> list[float]:
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.approxQuantile(order_col, probs, 1.0 / (4 * buckets))
    return sorted({float(b) for b in bounds})


def bucket_expr(order_col: str, bounds: list[float], descending: bool):
    """Bucket index: the number of sorted boundaries strictly below the value (NULL: none).

    A binary search in one array literal, so the plan has the same few nodes
    for any number of boundaries and a row takes log2(k) steps.
    """
    if not bounds:
        return F.lit(0)
    k = len(bounds)
    # a folded constant; an array of k literals would be k nodes of the plan
    array = f"cast(split('{','.join(repr(float(b)) for b in bounds)}', ',') as array<double>)"
    steps = [1 << i for i in reversed(range(k.bit_length()))]
    below = (f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
             f"if(at + step <= {k} and get({array}, at + step - 1) < `{order_col}`, at + step, at))")
    # ascending: bucket = boundaries below the value; descending: mirror it.
    return F.expr(below if not descending else f"{k} - ({below})")


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], group_cols=(),
                 descending: bool = True, buckets: int | None = None,
                 bounds: list[float] | None = None, prefix: str = "cum_",
                 with_totals: bool = False) -> DataFrame:
    """Adds ``cum_<c>`` = inclusive running sum of ``c`` in ``order_col``
    order (per group), and ``total_<c>`` (the group total) when asked; the
    totals ride on the small offsets table, so no extra join is needed."""
    group_cols = list(group_cols)
    if bounds is None:
        df = materialize(df)
        bounds = bucket_boundaries(df, order_col, buckets or default_buckets(df))
    b = df.withColumn("_bucket", bucket_expr(order_col, bounds, descending))
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = (Window.partitionBy(*group_cols).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(*group_cols, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols], *[
        F.sum(f"_t_{c}").over(whole).alias(f"total_{c}") for c in (sum_cols if with_totals else [])])
    j = join_on_groups(b, offsets, [*group_cols, "_bucket"])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = (Window.partitionBy(*group_cols, "_bucket").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return j.select(*df.columns, *[
        (F.sum(c).over(within) + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
        *[f"total_{c}" for c in (sum_cols if with_totals else [])])


def dense_positions(df: DataFrame, order_cols: list[str], group_cols=(), bucket_col: str | None = None,
                    buckets: int | None = None) -> DataFrame:
    """1-based row position within each group in ``order_cols`` order
    (ascending), distributed the same way: the caller supplies a numeric
    ``bucket_col`` that is monotone in the order (e.g. a hash unit); the
    position is running count of rows."""
    if bucket_col is None:
        raise ValueError("dense_positions needs a numeric column monotone in the order")
    counted = materialize(df)
    group_cols = list(group_cols)
    bounds = bucket_boundaries(counted, bucket_col, buckets or default_buckets(df))
    b = counted.withColumn("_bucket", bucket_expr(bucket_col, bounds, descending=False))
    totals = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_t"))
    before = (Window.partitionBy(*group_cols).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, "_bucket",
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    j = join_on_groups(b, offsets, [*group_cols, "_bucket"])
    within = Window.partitionBy(*group_cols, "_bucket").orderBy(*[F.col(c).asc() for c in order_cols])
    return j.select(*df.columns, (F.row_number().over(within) + F.col("_o")).alias("position"))


def sums_before(df: DataFrame, order_cols: list[str], sum_cols: list[str], group_cols, bucket_col: str,
                buckets: int | None = None) -> DataFrame:
    """Adds ``before_<c>``: the sum of ``c`` over the rows of the group that come earlier in ``order_cols``.

    As ``dense_positions``, the caller supplies a numeric ``bucket_col`` that
    is monotone in the order; rows of one group are spread over the buckets,
    so a hot group is no single task.
    """
    rows = materialize(df)
    group_cols = list(group_cols)
    bounds = bucket_boundaries(rows, bucket_col, buckets or default_buckets(df))
    b = rows.withColumn("_bucket", bucket_expr(bucket_col, bounds, descending=False))
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = (Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    within = (Window.partitionBy(*group_cols, "_bucket").orderBy(*[F.col(c).asc() for c in order_cols])
              .rowsBetween(Window.unboundedPreceding, -1))
    return join_on_groups(b, offsets, [*group_cols, "_bucket"]).select(*df.columns, *[
        (F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sum_cols])
