"""raw -> staging -> mart, as lazy DataFrame functions.

Staging is a view (a lazy plan); the mart is a table that can be
materialised with ``churnlake.sources.sinks.materialise``. Because both are
plain projections, Catalyst collapses raw->staging->mart into one Project
over the raw plan and prunes the scan to the columns a query really uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.schemas import (LABEL_ATTRITED, LABEL_EXISTING, MART_COLUMNS,
                               RAW_TO_STAGING, STAGING_COLUMNS, TRIMMED_COLUMNS)


def staging_columns() -> dict:
    """Staging column name -> expression over the raw columns.

    ``churn_flag`` compares the *untrimmed* label and has no ELSE branch,
    so a padded or unknown label yields a NULL flag while
    ``attrition_status`` (trimmed) still looks valid.
    """
    label = F.col("attrition_flag")
    churn_flag = (F.when(label == LABEL_ATTRITED, F.lit(1))
                  .when(label == LABEL_EXISTING, F.lit(0)))
    cols = {"attrition_status": F.trim(label), "churn_flag": churn_flag}
    for raw_name, name in RAW_TO_STAGING:
        c = F.col(raw_name)
        cols[name] = F.trim(c) if name in TRIMMED_COLUMNS else c
    return cols


def stage(raw: DataFrame) -> DataFrame:
    """Rename, trim and derive the target (see ``staging_columns``)."""
    cols = staging_columns()
    return raw.select(*[cols[n].alias(n) for n in STAGING_COLUMNS])


def mart(staging: DataFrame) -> DataFrame:
    """Model-ready mart: id, target and the 19 features (leak columns gone)."""
    return staging.select(*MART_COLUMNS)


def build_mart(spark, sf_dir: str) -> DataFrame:
    from churnlake.sources.fixture import churn_raw
    return mart(stage(churn_raw(spark, sf_dir)))
