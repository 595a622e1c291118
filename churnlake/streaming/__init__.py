"""Streaming: the reference has no streams, watermarks or state.

Scoring is stateless per row, so the batch scoring transform applies
unchanged to a streaming mart source (new mart files arriving in a
folder). This module only wires that up; it is not a separate operator.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from churnlake.plans.scoring import fixed_scorer, score_portfolio
from churnlake.schemas import MART_SCHEMA


def score_mart_stream(spark: SparkSession, mart_dir: str, out_dir: str, checkpoint_dir: str,
                      scorer=fixed_scorer, scored_at: str | None = None):
    """Score every new mart file under ``mart_dir`` into Parquet at
    ``out_dir``; the query checkpoint makes restarts exactly-once."""
    stream = spark.readStream.schema(MART_SCHEMA).parquet(mart_dir)
    scored = score_portfolio(stream, scorer, scored_at=scored_at)
    return (scored.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
