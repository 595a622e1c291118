"""Churn-shaped raw snapshot derived from the synthetic star schema.

One row per customer with at least one order before the point-in-time
cut ``T``. Features look only at orders before ``T``; the label looks at
orders from ``T`` on (no order from ``T`` on -> attrited).

Plan shape (one scan of ``orders``, one of ``customer``, one of ``events``):

* orders are pre-aggregated by ``(o_custkey, o_orderpriority)`` with
  map-side partial aggregation, so a customer owning a third of all orders
  still reaches the shuffle as a handful of rows per task; the second
  level folds priorities into one row per customer and yields the exact
  distinct-priority count without an Expand of the input.
* the label is a conditional aggregate of the same scan, not a second
  pass over ``orders``.
* the three inputs meet on the customer key, so the sort-merge joins
  share one hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.schemas import LABEL_ATTRITED, LABEL_EXISTING, LEAK_COLUMNS, RAW_SCHEMA

# Fixed values of the derivation.
CUTOFF = "2000-07-01"
MARITAL_BY_KEY_MOD_4 = ["Married", "Single", "Divorced", "Unknown"]
INCOME_BANDS = [  # (upper bound on c_acctbal, label); last one has no bound
    (0.0, "Less than $40K"),
    (4000.0, "$40K - $60K"),
    (8000.0, "$60K - $80K"),
    (None, "$80K - $120K"),
]
CARD_SILVER_FROM = 9000.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_profile(orders: DataFrame) -> DataFrame:
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    before = F.col("o_orderdate") < cut
    price = F.col("o_totalprice").cast("decimal(18,2)")
    quarter = F.quarter("o_orderdate")
    by_priority = (
        orders.select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(
            F.count_if(before).alias("n"),
            F.count_if(~before).alias("n_after"),
            F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
            F.max(F.when(before, F.col("o_orderdate"))).alias("last_order"),
            F.sum(F.when(before, price)).alias("amt"),
            F.sum(F.when(before & (quarter == 4), price)).alias("q4_amt"),
            F.sum(F.when(before & (quarter == 1), price)).alias("q1_amt"),
            F.count_if(before & (quarter == 4)).alias("q4_ct"),
            F.count_if(before & (quarter == 1)).alias("q1_ct"),
        )
    )
    return (
        by_priority.groupBy("o_custkey")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_after").alias("n_after"),
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
            F.count_if((F.col("n") > 0) & F.col("o_orderpriority").isNotNull())
            .alias("n_priorities"),
            F.sum("amt").alias("amt"),
            F.sum("q4_amt").alias("q4_amt"),
            F.sum("q1_amt").alias("q1_amt"),
            F.sum("q4_ct").alias("q4_ct"),
            F.sum("q1_ct").alias("q1_ct"),
        )
        .filter(F.col("n") > 0)
    )


def _income(balance):
    expr = None
    for bound, label in INCOME_BANDS:
        if bound is None:
            expr = expr.otherwise(F.lit(label))
        elif expr is None:
            expr = F.when(balance < bound, F.lit(label))
        else:
            expr = expr.when(balance < bound, F.lit(label))
    return expr


def churn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23-column raw snapshot (``RAW_SCHEMA``)."""
    cut = F.lit(CUTOFF).cast("date")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    profile = _order_profile(read_table(spark, sf_dir, "orders"))
    contacts = (
        read_table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "error")
        .groupBy("user_id").agg(F.count("*").alias("contacts"))
    )
    joined = (
        customer.join(profile, customer.c_custkey == profile.o_custkey, "inner")
        .join(contacts, F.col("c_custkey") == contacts.user_id, "left")
    )
    key = F.col("c_custkey")
    bal = F.col("c_acctbal")
    # Money in exact cents: balances carry two decimals, so DECIMAL(18,2)
    # arithmetic is exact and the double it is cast to is engine-independent.
    cents = bal.cast("decimal(18,2)")
    credit_limit = (F.lit(1000).cast("decimal(18,2)") + F.lit(3) * F.abs(cents)).cast("double")
    revolving = F.greatest(cents, F.lit(0).cast("decimal(18,2)")).cast("double")
    open_to_buy = (F.lit(1000).cast("decimal(18,2)") + F.lit(3) * F.abs(cents)
                   - F.greatest(cents, F.lit(0).cast("decimal(18,2)"))).cast("double")
    attrited = F.col("n_after") == 0
    marital = F.element_at(F.array(*[F.lit(m) for m in MARITAL_BY_KEY_MOD_4]),
                           (F.pmod(key, F.lit(4)) + 1).cast("int"))
    out = joined.select(
        key.alias("client_num"),
        F.when(attrited, F.lit(LABEL_ATTRITED)).otherwise(F.lit(LABEL_EXISTING))
        .alias("attrition_flag"),
        (F.lit(18) + F.pmod(key * 7, F.lit(55))).cast("int").alias("customer_age"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit(" F")).otherwise(F.lit("M ")).alias("gender"),
        F.pmod(F.col("c_nationkey"), F.lit(6)).cast("int").alias("dependent_count"),
        F.col("c_mktsegment").alias("education_level"),
        marital.alias("marital_status"),
        _income(bal).alias("income_category"),
        F.when(bal < CARD_SILVER_FROM, F.lit("Blue")).otherwise(F.lit("Silver"))
        .alias("card_category"),
        F.floor(F.datediff(cut, F.col("first_order")) / F.lit(30.0)).cast("int")
        .alias("months_on_book"),
        F.col("n_priorities").cast("int").alias("total_relationship_count"),
        F.least(F.lit(12), F.floor(F.datediff(cut, F.col("last_order")) / F.lit(30.0)))
        .cast("int").alias("months_inactive_12_mon"),
        F.coalesce(F.col("contacts"), F.lit(0)).cast("int").alias("contacts_count_12_mon"),
        credit_limit.alias("credit_limit"),
        revolving.alias("total_revolving_bal"),
        open_to_buy.alias("avg_open_to_buy"),
        (F.col("q4_amt").cast("double") / F.nullif(F.col("q1_amt").cast("double"), F.lit(0.0)))
        .alias("total_amt_chng_q4_q1"),
        F.col("amt").cast("double").alias("total_trans_amt"),
        F.col("n").cast("int").alias("total_trans_ct"),
        (F.col("q4_ct") / F.nullif(F.col("q1_ct"), F.lit(0))).alias("total_ct_chng_q4_q1"),
        (revolving / credit_limit).alias("avg_utilization_ratio"),
        F.when(attrited, F.lit(0.99)).otherwise(F.lit(0.01)).alias(LEAK_COLUMNS[0]),
        F.when(attrited, F.lit(0.01)).otherwise(F.lit(0.99)).alias(LEAK_COLUMNS[1]),
    )
    assert out.columns == RAW_SCHEMA.names, out.columns
    return out
