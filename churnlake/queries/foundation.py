"""Scans, layers and simple profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.oracle import CHAIN, sql
from churnlake.queries.common import raw_df, staging_df
from churnlake.registry import register


@register("staging_scan", sql(*CHAIN, body="SELECT * FROM stg"))
def staging_scan(spark, sf):
    return staging_df(spark, sf)


@register("target_distribution", sql(*CHAIN, body="""
SELECT attrition_flag, CAST(count(*) AS BIGINT) AS customers FROM raw GROUP BY attrition_flag"""))
def target_distribution(spark, sf):
    return raw_df(spark, sf).groupBy("attrition_flag").agg(F.count(F.lit(1)).alias("customers"))
