"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.operators.blocks import MAX_BROADCAST_IDS, few_rows, host_guest_blocks, runs  # noqa: F401
from churnlake.session import new_table_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space of the word contracts: [\x20\x09-\x0D]. ``bytes.split()`` uses the same set.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def _importable(spark: SparkSession) -> None:
    """Let Python workers of a local run import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), _ROOT]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    _importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back (cuts lineage)."""
    path = new_table_path(spark, f"llm_{name}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def semi_join_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (one column ``key``, null matches null).

    The ids are counted first: up to MAX_BROADCAST_IDS they are broadcast,
    so that the wide rows stay where they are; beyond it Spark joins them.
    """
    right = ids.select(F.col(key).alias("__id")).distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(right) if few else right,
                     F.col(key).eqNullSafe(F.col("__id")), "left_semi")


def hash_sample(rows: DataFrame, by: str, columns: list[str], k: int) -> DataFrame:
    """At most ``k`` different rows (by, *columns) for each value of ``by``: about those with the smallest hash.

    Rows are known by their content, so repeated rows and repeated ids count
    once. A threshold on the hash, from the counted rows, leaves some 4 k rows
    of a value before any are ranked, so neither the number of tasks nor a hot
    id brings many rows together.
    """
    span = 1 << 30
    h = F.xxhash64(*columns)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(by, "__by")
    # counted first, so that the wide rows stay where they are while the values of ``by`` are few
    sizes = F.broadcast(sizes) if few_rows(sizes) else sizes
    some = rows.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).where(
        F.pmod(h, F.lit(span)) * F.col("__n") <= 4.0 * k * span)
    once = some.groupBy(by, h.alias("__h")).agg(F.first(F.struct(*columns)).alias("__row"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("__h"))
    return once.withColumn("__nth", nth).where(F.col("__nth") <= k).select(by, "__row.*")


#: Edges (16 bytes each) that one task takes in a step of the components, and tasks of a step at least.
EDGES_A_TASK, LEAST_TASKS = 100_000, 8


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b).

    ``component`` is the smallest node that can be reached. Alternating
    large-star / small-star steps: each is a grouped minimum (combined on the
    map side) and one join, so a hub is split by Spark's skew join and the
    number of steps grows with the logarithm of a path's length. Every step
    is a written table. A step has no more tasks than its counted edges need,
    since each task writes files of its own for each of its exchanges. Loops
    and repeated edges are allowed; nodes without an edge to another node do
    not appear.
    """
    cur = stage(spark, edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc_edges")
    before, tasks = None, max(LEAST_TASKS, -(-cur.count() // EDGES_A_TASK))
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low2, "u").coalesce(tasks)
        small = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low2.select("u", F.col("m").alias("v")).coalesce(tasks))
        cur = stage(spark, small.distinct().coalesce(tasks), "cc_edges")
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
