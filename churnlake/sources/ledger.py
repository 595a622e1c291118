"""Run ledger and model-version registry as append-only Parquet tables.

Ledger rows are long ``(run_name, kind, key, value_text, value_double)``:
params are stringified (missing -> 'None'), metrics are doubles, tags are
text. Versions are text and compared numerically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.columns import safe_text

LEDGER_SCHEMA = "run_name string, kind string, key string, value_text string, value_double double"


def ledger_rows(run_name: str, values: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Unpivot a one-row frame of run values into ledger rows. ``kinds``
    maps each column to 'param', 'metric' or 'tag'."""
    cols = list(kinds)
    as_text = values.select(*[safe_text(F.col(c)).alias(c) for c in cols])
    as_num = values.select(*[(F.col(c).cast("double") if kinds[c] == "metric"
                              else F.lit(None).cast("double")).alias(c) for c in cols])
    t = as_text.unpivot([], cols, "key", "value_text")
    d = as_num.unpivot([], cols, "key", "value_double")
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds[c]))])
    return t.join(d, "key").select(F.lit(run_name).alias("run_name"), kind_map[F.col("key")].alias("kind"),
                                   "key", "value_text", "value_double")


def append_ledger(rows: DataFrame, path: str) -> str:
    rows.write.mode("append").parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def latest_versions(registry: DataFrame) -> DataFrame:
    """Newest version per model by *numeric* version ('10' > '9'), and the
    version the 'champion' alias points at."""
    v = F.col("version").cast("int")
    newest = registry.groupBy("model_name").agg(F.max(v).alias("latest_version"))
    champ = (registry.filter(F.col("alias") == "champion").groupBy("model_name")
             .agg(F.max_by(v, v).alias("champion_version")))
    return newest.join(champ, "model_name", "left")
