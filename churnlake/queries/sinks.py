"""Source / sink queries: each writes to a fresh folder under the shared
checkpoint directory and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import quality as Q
from churnlake.oracle import CHAIN, SCORED, SCORED_AT, sql
from churnlake.plans import publish as P
from churnlake.queries.common import mart_df, predictions_df, raw_df, staging_df
from churnlake.registry import register, round_doubles
from churnlake.schemas import (CLASSIFICATION_THRESHOLD, MART_COLUMNS, PREDICTION_COLUMNS,
                               RAW_SCHEMA, SOURCE_TABLE, TARGET_TABLE, WATCHLIST_THRESHOLD)
from churnlake.session import new_table_path
from churnlake.sources import files
from churnlake.sources import ledger as LG

_PRED_SQL_COLS = ("customer_id, round(churn_probability, 6) AS churn_probability, risk_band, churn_prediction, "
                  "model_name, model_version, model_alias, scored_at")


def _csv_roundtrip(spark, sf):
    path = files.write_csv(raw_df(spark, sf), new_table_path(spark, "raw_csv"))
    return path, files.scan_csv(spark, path, RAW_SCHEMA)


@register("scan_csv_roundtrip", sql(*CHAIN, body="SELECT * FROM raw"))
def scan_csv_roundtrip(spark, sf):
    _, df = _csv_roundtrip(spark, sf)
    return df.select(*RAW_SCHEMA.names)


@register("source_file_facts", sql(*CHAIN, body="""
SELECT CAST(count(*) AS BIGINT) AS rows, true AS names_differ, true AS all_tagged, true AS tags_follow_content FROM raw"""))
def source_file_facts(spark, sf):
    """Rows over all files of the source, and whether each file has its own
    name and a content tag that a second reading confirms."""
    path, _ = _csv_roundtrip(spark, sf)
    facts = files.file_facts(spark, path, "csv", RAW_SCHEMA)
    again = files.file_facts(spark, path, "csv", RAW_SCHEMA).select("file_path", F.col("content_md5").alias("again"))
    return facts.join(again, "file_path").agg(
        F.sum("rows").cast("bigint").alias("rows"),
        (F.count_distinct("file_name") == F.count(F.lit(1))).alias("names_differ"),
        F.bool_and((F.length("content_md5") == 32) & (F.length("content_sha256") == 64)).alias("all_tagged"),
        F.bool_and(F.col("content_md5") == F.col("again")).alias("tags_follow_content"))


@register("reconcile_sources", sql(*CHAIN, body="""
SELECT metric, value AS file_source, value AS table_source, true AS matches FROM (
  SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT client_num) AS BIGINT) AS unique_customers,
    CAST(count(*) FILTER (WHERE attrition_flag = 'Existing Customer') AS BIGINT) AS existing_customers,
    CAST(count(*) FILTER (WHERE attrition_flag = 'Attrited Customer') AS BIGINT) AS attrited_customers
  FROM raw) UNPIVOT (value FOR metric IN (rows, unique_customers, existing_customers, attrited_customers))"""))
def reconcile_sources(spark, sf):
    _, csv = _csv_roundtrip(spark, sf)
    return Q.reconcile_sources(csv, raw_df(spark, sf))


@register("staging_view", sql(*CHAIN, body="""
SELECT customer_id, attrition_status, churn_flag, gender FROM stg"""))
def staging_view(spark, sf):
    # Staging is a view: a named lazy plan the SQL API can query.
    staging_df(spark, sf).createOrReplaceTempView("stg_bank_customers")
    return spark.sql("SELECT customer_id, attrition_status, churn_flag, gender FROM stg_bank_customers")


@register("mart_materialise", sql(*CHAIN, body="SELECT * FROM mart"))
def mart_materialise(spark, sf):
    from churnlake.plans.layers import mart
    path = files.write_parquet(mart(staging_df(spark, sf)), new_table_path(spark, "mart"), mode="overwrite")
    return files.read_parquet(spark, path).select(*MART_COLUMNS)


@register("mart_sample", sql(*CHAIN, body="SELECT * FROM mart ORDER BY customer_id LIMIT 10"))
def mart_sample(spark, sf):
    return mart_df(spark, sf).orderBy("customer_id").limit(10)


def _published(spark, sf):
    m = mart_df(spark, sf)
    return P.publish_batch(spark, predictions_df(spark, sf), new_table_path(spark, "predictions"),
                           new_table_path(spark, "curated"), expected_rows_from=m)


def _below_root(uri, paths):
    """A stored URI as the source system names it: below ``curated``, if it really lies below the batch's root."""
    root = paths["snapshot"].rsplit("/", 1)[0]
    return F.when(uri.startswith(root + "/"), F.concat(F.lit("curated"), F.substring(uri, len(root) + 1, 1_000_000)))


@register("prediction_mart_write", sql(*CHAIN, SCORED, body=f"SELECT {_PRED_SQL_COLS} FROM scored"))
def prediction_mart_write(spark, sf):
    path = P.write_prediction_table(predictions_df(spark, sf), new_table_path(spark, "predictions"))
    return round_doubles(files.read_parquet(spark, path).select(*PREDICTION_COLUMNS))


@register("prediction_snapshot", sql(*CHAIN, SCORED, body=f"""
SELECT {_PRED_SQL_COLS}, CAST(scored_at AS DATE) AS scored_date FROM scored"""))
def prediction_snapshot(spark, sf):
    # the same batch twice: the second write replaces the first
    pred = predictions_df(spark, sf)
    root = new_table_path(spark, "curated")
    uri = P.batch_keys(pred, root).first()["snapshot_uri"]
    for _ in range(2):
        files.write_snapshot(pred, uri)
    return round_doubles(files.read_snapshot(spark, f"{root}/{P.SNAPSHOT_PREFIX}", SCORED_AT[:10]))


def _content(df):
    """The checksum's columns, probabilities in millionths (text that both engines write alike)."""
    return files.dataset_fingerprint(df, [
        F.round(F.col(c) * 1_000_000).cast("bigint") if c == "churn_probability" else c for c in P.CONTENT])


@register("snapshot_fingerprint", sql(*CHAIN, SCORED, f"""
h AS (SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', customer_id,
    CAST(round(churn_probability * 1000000) AS BIGINT), risk_band, churn_prediction, model_name, model_version,
    model_alias)), 1, 8))::BIGINT) AS s FROM scored)""", body="""
SELECT d AS dataset, CAST(n AS BIGINT) AS rows, CAST(coalesce(s, 0) AS VARCHAR) AS hash_sum, true AS checksum_kept
FROM h, (VALUES ('prediction_table'), ('snapshot')) AS t(d)"""))
def snapshot_fingerprint(spark, sf):
    """Content of the stored table and of the snapshot behind its URI, and
    whether each still has the checksum that was stored with the batch."""
    paths = _published(spark, sf)
    lineage = files.read_parquet(spark, paths["lineage"])
    kept = files.read_parquet(spark, paths["checksum"]).select(F.struct("rows", "hash_sum").alias("k")).scalar()
    out = None
    for name, df in (("prediction_table", lineage), ("snapshot", P.recovered_snapshot(spark, lineage))):
        same = files.dataset_fingerprint(df, P.CONTENT).select(F.struct("rows", "hash_sum").alias("k")).scalar()
        row = _content(df).select(F.lit(name).alias("dataset"), "rows", "hash_sum", (same == kept).alias("checksum_kept"))
        out = row if out is None else out.unionByName(row)
    return out


@register("snapshot_matches_mart", sql(*CHAIN, SCORED, body="""
SELECT CAST(0 AS BIGINT) AS only_in_table, CAST(0 AS BIGINT) AS only_in_snapshot,
       CAST(count(*) AS BIGINT) AS table_rows, CAST(count(*) AS BIGINT) AS snapshot_rows FROM scored"""))
def snapshot_matches_mart(spark, sf):
    """Row-by-row comparison of the table with the snapshot behind the URI that its rows carry."""
    paths = _published(spark, sf)
    lineage = files.read_parquet(spark, paths["lineage"])
    count = F.count(F.lit(1))
    both = lineage.select(*PREDICTION_COLUMNS, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(
        P.recovered_snapshot(spark, lineage).select(*PREDICTION_COLUMNS, F.lit(0).alias("_t"), F.lit(1).alias("_s")))
    per = both.groupBy(*PREDICTION_COLUMNS).agg(F.sum("_t").alias("t"), F.sum("_s").alias("s"), count.alias("n"))
    return per.agg(
        F.coalesce(F.sum(F.greatest(F.col("t") - F.col("s"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_table"),
        F.coalesce(F.sum(F.greatest(F.col("s") - F.col("t"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_snapshot"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("table_rows"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("snapshot_rows"))


_KEYS = f"""
keys AS (
  SELECT strftime(max(scored_at), '%Y-%m-%d') AS scored_date,
    strftime(max(scored_at), '%Y%m%dT%H%M%SZ') AS scoring_batch,
    'churn_predictions/scored_date=' || strftime(max(scored_at), '%Y-%m-%d') || '/churn_predictions_' || strftime(max(scored_at), '%Y%m%dT%H%M%SZ') || '.parquet' AS snapshot_key,
    'curated/churn_predictions/scored_date=' || strftime(max(scored_at), '%Y-%m-%d') || '/churn_predictions_' || strftime(max(scored_at), '%Y%m%dT%H%M%SZ') || '.parquet' AS snapshot_uri,
    'scoring-' || strftime(max(scored_at), '%Y%m%dT%H%M%SZ') AS scoring_run_id,
    strftime(max(scored_at), '%Y-%m-%dT%H:%M:%S+00:00') AS scored_at_iso
  FROM scored)"""


@register("snapshot_keys", sql(*CHAIN, SCORED, _KEYS, body="SELECT * FROM keys"))
def snapshot_keys(spark, sf):
    return P.batch_keys(predictions_df(spark, sf))


@register("prediction_lineage_attach", sql(*CHAIN, SCORED, _KEYS, body=f"""
SELECT {_PRED_SQL_COLS.replace('customer_id,', 's.customer_id,', 1)}, k.scoring_run_id, k.snapshot_uri FROM scored s, keys k"""))
def prediction_lineage_attach(spark, sf):
    paths = _published(spark, sf)
    return round_doubles(files.read_parquet(spark, paths["lineage"]).withColumn(
        "snapshot_uri", _below_root(F.col("snapshot_uri"), paths)))


@register("lineage_validation", sql(*CHAIN, SCORED, _KEYS, body="""
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(DISTINCT s.scoring_run_id) AS BIGINT) AS run_ids,
  min(s.scoring_run_id) AS scoring_run_id, CAST(count(DISTINCT s.snapshot_uri) AS BIGINT) AS snapshot_uris,
  min(s.snapshot_uri) AS snapshot_uri, CAST(count(DISTINCT s.model_version) AS BIGINT) AS model_versions,
  CAST(min(s.model_version) AS BIGINT) AS minimum_model_version, CAST(count(DISTINCT s.model_alias) AS BIGINT) AS model_aliases
FROM (SELECT scored.*, keys.scoring_run_id, keys.snapshot_uri FROM scored, keys) s"""))
def lineage_validation(spark, sf):
    paths = _published(spark, sf)
    t = files.read_parquet(spark, paths["lineage"]).withColumn("snapshot_uri", _below_root(F.col("snapshot_uri"), paths))
    return t.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        F.count_distinct("scoring_run_id").cast("bigint").alias("run_ids"),
        F.min("scoring_run_id").alias("scoring_run_id"),
        F.count_distinct("snapshot_uri").cast("bigint").alias("snapshot_uris"),
        F.min("snapshot_uri").alias("snapshot_uri"),
        F.count_distinct("model_version").cast("bigint").alias("model_versions"),
        F.min("model_version").cast("bigint").alias("minimum_model_version"),
        F.count_distinct("model_alias").cast("bigint").alias("model_aliases"))


@register("prediction_mart_profile", sql(*CHAIN, SCORED, body="""
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers,
  round(min(churn_probability), 6) AS minimum_probability, round(max(churn_probability), 6) AS maximum_probability,
  CAST(count(DISTINCT model_version) AS BIGINT) AS model_versions, CAST(min(model_version) AS BIGINT) AS minimum_model_version,
  CAST(max(model_version) AS BIGINT) AS maximum_model_version, max(scored_at) AS latest_scoring
FROM scored"""))
def prediction_mart_profile(spark, sf):
    path = P.write_prediction_table(predictions_df(spark, sf), new_table_path(spark, "predictions"))
    t = files.read_parquet(spark, path)
    return round_doubles(t.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        F.count_distinct("customer_id").cast("bigint").alias("unique_customers"),
        F.min("churn_probability").alias("minimum_probability"),
        F.max("churn_probability").alias("maximum_probability"),
        F.count_distinct("model_version").cast("bigint").alias("model_versions"),
        F.min("model_version").cast("bigint").alias("minimum_model_version"),
        F.max("model_version").cast("bigint").alias("maximum_model_version"),
        F.max("scored_at").alias("latest_scoring")))


_SUMMARY_SCALARS = ["source_table", "target_table", "snapshot_uri", "scored_at", "customers_scored",
                    "unique_customers", "model_name", "model_version", "model_alias",
                    "watchlist_threshold", "classification_threshold", "risk_low", "risk_medium", "risk_high"]


_SUMMARY_SQL = sql(*CHAIN, SCORED, _KEYS, body=f"""
SELECT '{SOURCE_TABLE}' AS source_table, '{TARGET_TABLE}' AS target_table,
  (SELECT snapshot_uri FROM keys) AS snapshot_uri, (SELECT scored_at_iso FROM keys) AS scored_at,
  CAST(count(*) AS BIGINT) AS customers_scored, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers,
  max(model_name) AS model_name, max(model_version) AS model_version, max(model_alias) AS model_alias,
  CAST({WATCHLIST_THRESHOLD} AS DOUBLE) AS watchlist_threshold, CAST({CLASSIFICATION_THRESHOLD} AS DOUBLE) AS classification_threshold,
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS BIGINT) AS risk_low,
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS BIGINT) AS risk_medium,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS BIGINT) AS risk_high
FROM scored""")


@register("scoring_summary", _SUMMARY_SQL)
def scoring_summary(spark, sf):
    pred = predictions_df(spark, sf)
    s = P.scoring_summary(pred, P.batch_keys(pred), SOURCE_TABLE,
                          TARGET_TABLE, WATCHLIST_THRESHOLD, CLASSIFICATION_THRESHOLD)
    return s.select(*_SUMMARY_SCALARS)


@register("scoring_summary_document", _SUMMARY_SQL)
def scoring_summary_document(spark, sf):
    pred = predictions_df(spark, sf)
    s = P.scoring_summary(pred, P.batch_keys(pred), SOURCE_TABLE,
                          TARGET_TABLE, WATCHLIST_THRESHOLD, CLASSIFICATION_THRESHOLD)
    path = new_table_path(spark, "scoring_summary")
    s.select("document").write.mode("errorifexists").text(path)
    bands = ["Low", "Medium", "High"]
    doc = F.from_json("value", "source_table string, target_table string, snapshot_uri string, scored_at string, "
                      "customers_scored bigint, unique_customers bigint, model_name string, model_version int, "
                      "model_alias string, watchlist_threshold double, classification_threshold double, "
                      "risk_distribution struct<Low: bigint, Medium: bigint, High: bigint>")
    parsed = spark.read.text(path).select(doc.alias("d")).select("d.*")
    return parsed.select("*", *[F.col(f"risk_distribution.{b}").alias(f"risk_{b.lower()}") for b in bands]).select(
        *_SUMMARY_SCALARS)


_LEDGER_KINDS = {"model_name": "param", "model_version": "param", "model_alias": "param",
                 "watchlist_threshold": "param", "classification_threshold": "param",
                 "scoring_run_id": "param", "customers_scored": "metric", "high_risk_customers": "metric",
                 "medium_risk_customers": "metric", "low_risk_customers": "metric",
                 "average_churn_probability": "metric", "source_table": "tag"}


@register("run_ledger", sql(*CHAIN, SCORED, _KEYS, body=f"""
SELECT 'portfolio-scoring' AS run_name, 'metric' AS kind, key, CAST(value AS VARCHAR) AS value_text, value AS value_double
FROM (SELECT CAST(count(*) AS DOUBLE) AS customers_scored,
        CAST(count(*) FILTER (WHERE risk_band = 'High') AS DOUBLE) AS high_risk_customers,
        CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS DOUBLE) AS medium_risk_customers,
        CAST(count(*) FILTER (WHERE risk_band = 'Low') AS DOUBLE) AS low_risk_customers,
        round(avg(churn_probability), 6) AS average_churn_probability FROM scored)
UNPIVOT (value FOR key IN (customers_scored, high_risk_customers, medium_risk_customers, low_risk_customers,
  average_churn_probability))
UNION ALL
SELECT 'portfolio-scoring', CASE WHEN key = 'source_table' THEN 'tag' ELSE 'param' END, key, value, NULL
FROM (SELECT max(model_name) AS model_name, CAST(max(model_version) AS VARCHAR) AS model_version,
        max(model_alias) AS model_alias, '{WATCHLIST_THRESHOLD}' AS watchlist_threshold,
        '{CLASSIFICATION_THRESHOLD}' AS classification_threshold,
        (SELECT scoring_run_id FROM keys) AS scoring_run_id, '{SOURCE_TABLE}' AS source_table FROM scored)
UNPIVOT (value FOR key IN (model_name, model_version, model_alias, watchlist_threshold, classification_threshold,
  scoring_run_id, source_table))"""))
def run_ledger(spark, sf):
    pred = predictions_df(spark, sf)
    keys = P.batch_keys(pred)
    vals = pred.agg(
        F.max("model_name").alias("model_name"), F.max("model_version").alias("model_version"),
        F.max("model_alias").alias("model_alias"),
        F.lit(WATCHLIST_THRESHOLD).alias("watchlist_threshold"),
        F.lit(CLASSIFICATION_THRESHOLD).alias("classification_threshold"),
        F.count(F.lit(1)).cast("double").alias("customers_scored"),
        F.count_if(F.col("risk_band") == "High").cast("double").alias("high_risk_customers"),
        F.count_if(F.col("risk_band") == "Medium").cast("double").alias("medium_risk_customers"),
        F.count_if(F.col("risk_band") == "Low").cast("double").alias("low_risk_customers"),
        F.round(F.avg("churn_probability"), 6).alias("average_churn_probability"),
        F.lit(SOURCE_TABLE).alias("source_table"))
    from churnlake.functions.columns import with_row
    vals = with_row(vals, keys.select("scoring_run_id"))
    path = LG.append_ledger(LG.ledger_rows("portfolio-scoring", vals, _LEDGER_KINDS),
                            new_table_path(spark, "ledger"))
    return LG.read_ledger(spark, path)


_CANDIDATES = """
cand AS (
  SELECT CAST(CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT) % 10 + 1 AS INTEGER) AS version,
    churn_flag AS label, churn_probability AS score
  FROM mart JOIN probs USING (customer_id)),
cg AS (SELECT version, score AS threshold, count(*) AS n, sum(label) AS tp FROM cand GROUP BY version, score),
cp AS (SELECT version, tp, CAST(sum(tp) OVER (PARTITION BY version ORDER BY threshold DESC) AS DOUBLE)
          / sum(n) OVER (PARTITION BY version ORDER BY threshold DESC) AS precision,
        sum(tp) OVER (PARTITION BY version) AS positives FROM cg),
ap AS (SELECT version, sum(CAST(tp AS DOUBLE) / nullif(positives, 0) * precision) AS average_precision FROM cp GROUP BY version)"""


@register("latest_version", sql(*CHAIN, SCORED, _CANDIDATES, body="""
SELECT 'churn-scorer' AS model_name, CAST(max(version) AS INTEGER) AS latest_version,
  CAST((SELECT version FROM ap ORDER BY round(average_precision, 9) DESC NULLS LAST, version DESC LIMIT 1) AS INTEGER) AS champion_version
FROM ap"""))
def latest_version(spark, sf):
    """One candidate version per hash bucket of customers ('1'..'10', text),
    evaluated by average precision; the best one carries the champion alias.
    The registry resolves the newest version numerically and the alias."""
    from churnlake.functions.columns import hash_bucket
    from churnlake.operators.metrics import pr_table, ranking_metrics
    from churnlake.plans.scoring import fixed_scorer
    m = mart_df(spark, sf)
    scored = fixed_scorer(m).join(m.select("customer_id", "churn_flag"), "customer_id").select(
        (hash_bucket("42:", "customer_id", 10) + 1).cast("string").alias("version"),
        F.col("churn_flag").alias("label"), F.col("churn_probability").alias("score"))
    ap = ranking_metrics(pr_table(scored, group_cols=["version"]), ["version"])
    best = ap.agg(F.max_by("version", F.struct(F.round("average_precision", 9),
                                               F.col("version").cast("int"))).alias("v")).select("v").scalar()
    registry = ap.select(F.lit("churn-scorer").alias("model_name"), "version",
                         F.when(F.col("version") == best, F.lit("champion")).alias("alias"))
    path = new_table_path(spark, "registry")
    registry.write.mode("errorifexists").parquet(path)
    return LG.latest_versions(spark.read.parquet(path))
