"""Publishing a scoring batch: prediction table, snapshot, lineage, summary.

Order matters and follows the source system: the batch is checked, then the
create-only prediction table and the snapshot are written; the lineage
columns are added to the table afterwards (so the snapshot does not carry
them); the summary document and the ledger rows describe the batch. A
batch's snapshot lies at the URI that its rows carry, with a manifest of its
files' SHA-256 and a checksum of its content beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.columns import band_ordinal
from churnlake.schemas import RISK_BANDS
from churnlake.sources import files

SNAPSHOT_PREFIX = "churn_predictions"


def batch_keys(pred: DataFrame, curated_root: str = "curated") -> DataFrame:
    """One row: batch instant -> partition date, batch id, snapshot key/URI
    below ``curated_root`` and a run id, all derived from the rows' own
    ``scored_at``."""
    ts = F.max("scored_at")
    one = pred.agg(ts.alias("scored_at"))
    batch = F.date_format("scored_at", "yyyyMMdd'T'HHmmss'Z'")
    day = F.date_format("scored_at", "yyyy-MM-dd")
    key = F.concat(F.lit(f"{SNAPSHOT_PREFIX}/scored_date="), day,
                   F.lit(f"/{SNAPSHOT_PREFIX}_"), batch, F.lit(".parquet"))
    return one.select(
        day.alias("scored_date"), batch.alias("scoring_batch"), key.alias("snapshot_key"),
        F.concat(F.lit(f"{curated_root}/"), key).alias("snapshot_uri"),
        F.concat(F.lit("scoring-"), batch).alias("scoring_run_id"),
        F.date_format("scored_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("scored_at_iso"))


def write_prediction_table(pred: DataFrame, path: str) -> str:
    """Create-only (fails if it exists). Files are clustered by band and by
    probability (descending) within each task: no shuffle, but min/max
    statistics prune band filters and top-probability scans."""
    return files.write_parquet(pred, path, mode="errorifexists",
                               sort_within=[band_ordinal("risk_band"), F.col("churn_probability").desc()])


def attach_lineage(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds (or replaces) scoring_run_id and snapshot_uri on every row."""
    run = keys.select("scoring_run_id").scalar()
    uri = keys.select("snapshot_uri").scalar()
    base = table.drop("scoring_run_id", "snapshot_uri")
    return base.select("*", run.alias("scoring_run_id"), uri.alias("snapshot_uri"))


def risk_distribution(pred: DataFrame) -> DataFrame:
    """One row with one count column per band (zero when absent)."""
    return pred.agg(*[F.count_if(F.col("risk_band") == b).cast("bigint").alias(b) for b in RISK_BANDS])


def scoring_summary(pred: DataFrame, keys: DataFrame, source_table: str, target_table: str,
                    watchlist: float, classification: float, snapshot_sha256: str | None = None) -> DataFrame:
    """The batch's summary as one row (scalars + a nested JSON document, with the snapshot's SHA-256 if given)."""
    stats = pred.agg(
        F.count(F.lit(1)).cast("bigint").alias("customers_scored"),
        F.count_distinct("customer_id").cast("bigint").alias("unique_customers"),
        F.max("model_name").alias("model_name"),
        F.max("model_version").alias("model_version"),
        F.max("model_alias").alias("model_alias"),
        *[F.count_if(F.col("risk_band") == b).cast("bigint").alias(f"risk_{b.lower()}") for b in RISK_BANDS])
    k = keys.select(F.struct("snapshot_uri", "scored_at_iso").alias("k")).scalar()
    row = stats.select(
        F.lit(source_table).alias("source_table"), F.lit(target_table).alias("target_table"),
        k["snapshot_uri"].alias("snapshot_uri"), k["scored_at_iso"].alias("scored_at"),
        "customers_scored", "unique_customers", "model_name", "model_version", "model_alias",
        F.lit(watchlist).alias("watchlist_threshold"), F.lit(classification).alias("classification_threshold"),
        *[f"risk_{b.lower()}" for b in RISK_BANDS])
    doc = F.to_json(F.struct(
        *[F.col(c) for c in ["source_table", "target_table", "snapshot_uri", "scored_at", "customers_scored",
                             "unique_customers", "model_name", "model_version", "model_alias",
                             "watchlist_threshold", "classification_threshold"]],
        *([F.lit(snapshot_sha256).alias("snapshot_sha256")] if snapshot_sha256 else []),
        F.struct(*[F.col(f"risk_{b.lower()}").alias(b) for b in RISK_BANDS]).alias("risk_distribution")))
    return row.withColumn("document", doc)


def refuse_bad_batch(pred: DataFrame, expected_rows_from: DataFrame | None = None) -> None:
    """Raise ValueError naming every violated constraint or expectation."""
    from churnlake.operators.quality import prediction_constraints, scoring_expectations
    rows = prediction_constraints(pred).toDF("check", "failures").unionByName(
        scoring_expectations(pred, expected_rows_from).toDF("check", "failures"))
    bad = {r["check"]: r["failures"] for r in rows.filter(F.col("failures") > 0).collect()}  # a dozen checks
    if bad:
        raise ValueError(f"the batch is refused: {bad}")


#: Columns that a batch's checksum covers.
CONTENT = ["customer_id", "churn_probability", "risk_band", "churn_prediction", "model_name", "model_version",
           "model_alias"]


def publish_batch(spark: SparkSession, pred: DataFrame, table_path: str, curated_root: str,
                  expected_rows_from: DataFrame | None = None) -> dict:
    """Check the batch, write table + snapshot + checksum, then the lineage
    version of the table. Returns the paths and the snapshot's URI (the
    caller reads them back as DataFrames)."""
    from churnlake.operators.prefix import materialize
    pred = materialize(pred)
    refuse_bad_batch(pred, expected_rows_from)
    write_prediction_table(pred, table_path)
    stored = files.read_parquet(spark, table_path)
    keys = batch_keys(stored, curated_root).first()  # one row
    uri = files.write_snapshot(stored, keys["snapshot_uri"])
    checksum = f"{uri}.checksum"
    files.write_parquet(files.dataset_fingerprint(stored, CONTENT), checksum, mode="overwrite")
    lineage_path = table_path.rstrip("/") + "_lineage"
    files.write_parquet(attach_lineage(stored, batch_keys(stored, curated_root)), lineage_path, mode="errorifexists")
    return {"table": table_path, "snapshot": f"{curated_root}/{SNAPSHOT_PREFIX}", "lineage": lineage_path,
            "uri": uri, "checksum": checksum, "sha256": files.snapshot_digest(spark, uri)}


def recovered_snapshot(spark: SparkSession, lineage: DataFrame) -> DataFrame:
    """The snapshot behind the one URI that the published rows carry, if its bytes are those that were written."""
    uris = [r["snapshot_uri"] for r in lineage.select("snapshot_uri").distinct().limit(2).collect()]
    if len(uris) != 1:
        raise ValueError(f"the table carries {len(uris)} snapshot URIs, expected one")
    files.refuse_changed_files(spark, uris[0])
    return files.read_batch(spark, uris[0])
