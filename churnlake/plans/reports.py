"""Scoring reports: band summary, zero-filled band counts, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.columns import band_ordinal
from churnlake.schemas import RISK_BANDS


def risk_summary(pred: DataFrame) -> DataFrame:
    """Customers and mean probability per band, in business order."""
    return (pred.groupBy("risk_band")
            .agg(F.count(F.lit(1)).cast("bigint").alias("customers"),
                 F.avg("churn_probability").alias("average_probability"))
            .withColumn("band_order", band_ordinal("risk_band"))
            .orderBy("band_order"))


def band_domain(spark: SparkSession) -> DataFrame:
    """The closed band domain (three fixed labels)."""
    return spark.createDataFrame([(b,) for b in RISK_BANDS], "risk_band string")


def risk_counts(spark: SparkSession, pred: DataFrame) -> DataFrame:
    """Counts over the closed domain; absent bands get 0."""
    counts = (pred.filter(F.col("risk_band").isin(RISK_BANDS))
              .groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")))
    return (band_domain(spark).join(counts, "risk_band", "left")
            .select("risk_band", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("customers"))
            .orderBy(band_ordinal("risk_band")))


def top_risk(pred: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` by probability, id as the tie-break (TakeOrderedAndProject)."""
    return pred.orderBy(F.col("churn_probability").desc(), F.col("customer_id").asc()).limit(n)
