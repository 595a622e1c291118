"""Shared inputs for registered queries (all derived from the given tables).

Every call derives its layers anew from the tables in ``sf`` as they are at
that moment: raw, staging, mart and predictions are lazy plans, nothing is
kept by path or session, so each query pays for its own work and sees
changed inputs. A stored mart is an explicit step of the caller
(``plans.publish.write_prediction_table`` or ``sources.files.write_parquet``
with a path of its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlake.oracle import SCORED_AT
from churnlake.plans.layers import mart, stage
from churnlake.plans.scoring import score_portfolio
from churnlake.sources.fixture import churn_raw


def raw_df(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return churn_raw(spark, sf)


def staging_df(spark: SparkSession, sf: str) -> DataFrame:
    return stage(raw_df(spark, sf))


def mart_df(spark: SparkSession, sf: str) -> DataFrame:
    return mart(staging_df(spark, sf))


def predictions_df(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-scorer portfolio scoring with a fixed batch instant."""
    return score_portfolio(mart_df(spark, sf), scored_at=SCORED_AT)
