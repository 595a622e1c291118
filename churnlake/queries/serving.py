"""Scoring outputs and the read queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.oracle import CHAIN, SCORED, sql
from churnlake.plans import serving as V
from churnlake.queries.common import mart_df, predictions_df
from churnlake.registry import register, round_doubles


@register("batch_scoring", sql(*CHAIN, SCORED, body="""
SELECT customer_id, round(churn_probability, 6) AS churn_probability, risk_band, churn_prediction,
  model_name, model_version, model_alias, scored_at FROM scored"""))
def batch_scoring(spark, sf):
    return round_doubles(predictions_df(spark, sf))


@register("portfolio_summary", sql(*CHAIN, SCORED, body="""
SELECT CAST(count(*) AS BIGINT) AS total_customers,
  CAST(coalesce(sum(churn_prediction), 0) AS BIGINT) AS predicted_churn_customers,
  round(coalesce(avg(CAST(churn_prediction AS DOUBLE)), 0.0), 6) AS predicted_churn_rate,
  round(coalesce(avg(churn_probability), 0.0), 6) AS average_churn_probability,
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS BIGINT) AS low_risk_customers,
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS BIGINT) AS medium_risk_customers,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS BIGINT) AS high_risk_customers,
  CAST(min(model_version) AS BIGINT) AS minimum_model_version,
  CAST(max(model_version) AS BIGINT) AS maximum_model_version,
  max(model_alias) AS model_alias, max(scored_at) AS latest_scoring_at
FROM scored"""))
def portfolio_summary(spark, sf):
    return round_doubles(V.portfolio_summary(predictions_df(spark, sf)))


_FEATS = ", ".join(__import__("churnlake.schemas", fromlist=["x"]).FEATURE_COLUMNS)


def _all_customer_ids(spark, sf):
    from churnlake.sources.fixture import read_table
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))


@register("risk_banding", sql(*CHAIN, SCORED, body="""
SELECT customer_id, risk_band,
  CASE risk_band WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS band_order,
  CAST(churn_probability >= 0.4762 AND churn_probability < 0.5 AS BOOLEAN) AS between_cuts
FROM scored"""))
def risk_banding(spark, sf):
    from churnlake.functions.columns import band_ordinal
    p = F.col("churn_probability")
    return predictions_df(spark, sf).select(
        "customer_id", "risk_band", band_ordinal("risk_band").alias("band_order"),
        ((p >= 0.4762) & (p < 0.5)).alias("between_cuts"))


@register("threshold_predict", sql(*CHAIN, SCORED, body="""
SELECT customer_id, CAST(churn_probability >= 0.4762 AS INTEGER) AS official_prediction,
  CAST(churn_probability >= 0.5 AS INTEGER) AS default_prediction,
  CASE WHEN churn_probability >= 0.5 THEN 'churn' ELSE 'no_churn' END AS prediction_label
FROM scored"""))
def threshold_predict_q(spark, sf):
    from churnlake.functions.columns import prediction_label, threshold_predict
    pred = predictions_df(spark, sf)
    return pred.select("customer_id",
                       threshold_predict("churn_probability", 0.4762).alias("official_prediction"),
                       threshold_predict("churn_probability", 0.5).alias("default_prediction"),
                       prediction_label(threshold_predict("churn_probability", 0.5)).alias("prediction_label"))


@register("risk_summary", sql(*CHAIN, SCORED, body="""
SELECT risk_band, CAST(count(*) AS BIGINT) AS customers,
  round(avg(churn_probability), 6) AS average_probability,
  CASE risk_band WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS band_order
FROM scored GROUP BY risk_band"""))
def risk_summary(spark, sf):
    from churnlake.plans.reports import risk_summary as rs
    return round_doubles(rs(predictions_df(spark, sf)))


@register("risk_counts_zero_filled", sql(*CHAIN, SCORED, body="""
SELECT d.risk_band, CAST(coalesce(c.n, 0) AS BIGINT) AS customers
FROM (VALUES ('Low'), ('Medium'), ('High')) d(risk_band)
LEFT JOIN (SELECT risk_band, count(*) AS n FROM scored GROUP BY risk_band) c ON c.risk_band = d.risk_band"""))
def risk_counts_zero_filled(spark, sf):
    from churnlake.plans.reports import risk_counts
    return risk_counts(spark, predictions_df(spark, sf))


@register("portfolio_summary_empty", sql(*CHAIN, SCORED, body="""
SELECT CAST(count(*) AS BIGINT) AS total_customers,
  CAST(coalesce(sum(churn_prediction), 0) AS BIGINT) AS predicted_churn_customers,
  coalesce(avg(CAST(churn_prediction AS DOUBLE)), 0.0) AS predicted_churn_rate,
  coalesce(avg(churn_probability), 0.0) AS average_churn_probability,
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS BIGINT) AS low_risk_customers,
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS BIGINT) AS medium_risk_customers,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS BIGINT) AS high_risk_customers,
  CAST(min(model_version) AS BIGINT) AS minimum_model_version,
  CAST(max(model_version) AS BIGINT) AS maximum_model_version,
  max(model_alias) AS model_alias, max(scored_at) AS latest_scoring_at
FROM scored WHERE model_alias <> 'champion'"""))
def portfolio_summary_empty(spark, sf):
    """The summary of a model alias that scored nobody: zeros and NULLs, not an error."""
    return V.portfolio_summary(predictions_df(spark, sf).filter(F.col("model_alias") != "champion"))


@register("top_risk_customers", sql(*CHAIN, SCORED, body="""
SELECT customer_id, round(churn_probability, 6) AS churn_probability, risk_band, churn_prediction,
  model_name, model_version, model_alias, scored_at
FROM scored ORDER BY churn_probability DESC, customer_id LIMIT 10"""))
def top_risk_customers(spark, sf):
    from churnlake.plans.reports import top_risk
    return round_doubles(top_risk(predictions_df(spark, sf), 10))


_LIST_SQL = """
SELECT s.customer_id, m.customer_age, m.gender, round(s.churn_probability, 6) AS churn_probability,
  s.risk_band, s.churn_prediction, s.model_version, s.model_alias, s.scored_at
FROM scored s JOIN mart m ON m.customer_id = s.customer_id
{where}
ORDER BY s.churn_probability DESC NULLS FIRST, s.customer_id
LIMIT {limit} OFFSET {offset}"""


@register("customer_list", sql(*CHAIN, SCORED, body=_LIST_SQL.format(where="", limit=10, offset=20)))
def customer_list(spark, sf):
    return round_doubles(V.customer_list(predictions_df(spark, sf), mart_df(spark, sf), None, 10, 20))


@register("customer_list_high", sql(*CHAIN, SCORED, body=_LIST_SQL.format(
    where="WHERE s.risk_band = 'High'", limit=10, offset=0)))
def customer_list_high(spark, sf):
    return round_doubles(V.customer_list(predictions_df(spark, sf), mart_df(spark, sf), "High", 10, 0))


@register("customer_list_total", sql(*CHAIN, SCORED, body="""
SELECT CAST(count(*) AS BIGINT) AS total_matching FROM scored WHERE risk_band = 'High'"""))
def customer_list_total(spark, sf):
    return V.customer_list_total(predictions_df(spark, sf), "High")


@register("customer_list_header", sql(*CHAIN, SCORED, body="""
SELECT 'Medium' AS risk_band,
  (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE risk_band = 'Medium') AS total_matching,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM scored s JOIN mart m USING (customer_id)
     WHERE s.risk_band = 'Medium' ORDER BY s.churn_probability DESC NULLS FIRST, s.customer_id
     LIMIT 25 OFFSET 100)) AS returned_count,
  25 AS "limit", 100 AS "offset"
"""))
def customer_list_header(spark, sf):
    return V.customer_list_header(predictions_df(spark, sf), mart_df(spark, sf), "Medium", 25, 100)


@register("page_requests", """
WITH r AS (
  SELECT event_id AS request_id,
    CASE event_id % 7 WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'high' WHEN 5 THEN '' END AS risk_band,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN '7.5' ELSE CAST(event_id * 13 % 130 AS VARCHAR) END AS lim,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'x' ELSE CAST(event_id % 97 - 20 AS VARCHAR) END AS off
  FROM events),
t AS (SELECT request_id, risk_band, TRY_CAST(CASE WHEN regexp_full_match(coalesce(lim, '10'), '[+-]?[0-9]+') THEN coalesce(lim, '10') END AS BIGINT) AS l,
  TRY_CAST(CASE WHEN regexp_full_match(coalesce(off, '0'), '[+-]?[0-9]+') THEN coalesce(off, '0') END AS BIGINT) AS o FROM r),
c AS (SELECT *, coalesce(l BETWEEN 1 AND 100, false) AS lok, coalesce(o >= 0, false) AS ook,
  risk_band IS NULL OR risk_band IN ('Low', 'Medium', 'High') AS bok FROM t)
SELECT request_id, CASE WHEN bok THEN risk_band END AS risk_band, CASE WHEN lok THEN l END AS "limit",
  CASE WHEN ook THEN o END AS "offset", lok AND ook AND bok AS is_valid,
  array_to_string(list_filter([CASE WHEN NOT lok THEN 'limit' END, CASE WHEN NOT ook THEN 'offset' END,
    CASE WHEN NOT bok THEN 'risk_band' END], lambda x: x IS NOT NULL), ';') AS reasons FROM c""")
def page_requests(spark, sf):
    """Page requests made of all events, with bands, limits and offsets that are absent, right and wrong."""
    from churnlake.sources.fixture import read_table
    e = F.col("event_id")
    band = F.when(e % 7 == 1, "Low").when(e % 7 == 2, "Medium").when(e % 7 == 3, "High").when(e % 7 == 4, "high") \
        .when(e % 7 == 5, "")
    limit = F.when(e % 11 == 1, "7.5").when(e % 11 != 0, (e * 13 % 130).cast("string"))
    offset = F.when(e % 5 == 1, "x").when(e % 5 != 0, (e % 97 - 20).cast("string"))
    return V.check_page_requests(read_table(spark, sf, "events").select(
        e.alias("request_id"), band.alias("risk_band"), limit.alias("limit"), offset.alias("offset")))


@register("customer_details", sql(*CHAIN, SCORED, body=f"""
SELECT c.customer_id, (m.customer_id IS NOT NULL) AS found,
  {", ".join("m." + f for f in _FEATS.split(", "))},
  round(s.churn_probability, 6) AS stored_churn_probability, s.risk_band AS stored_risk_band,
  s.churn_prediction AS stored_churn_prediction, s.model_name AS stored_model_name,
  s.model_version AS stored_model_version, s.model_alias AS stored_model_alias,
  s.scored_at AS stored_scored_at, CAST(NULL AS VARCHAR) AS stored_scoring_run_id
FROM (SELECT DISTINCT c_custkey AS customer_id FROM customer) c
LEFT JOIN mart m ON m.customer_id = c.customer_id
LEFT JOIN scored s ON s.customer_id = c.customer_id"""))
def customer_details(spark, sf):
    details = V.customer_details(_all_customer_ids(spark, sf), mart_df(spark, sf), predictions_df(spark, sf))
    flat = V.flatten_details(details)
    return flat.withColumn("stored_churn_probability", F.round("stored_churn_probability", 6))


@register("rescore_compare", sql(*CHAIN, SCORED, body="""
SELECT m.customer_id, CAST(p.churn_probability >= 0.5 AS INTEGER) AS churn_prediction,
  CASE WHEN p.churn_probability >= 0.5 THEN 'churn' ELSE 'no_churn' END AS prediction_label,
  s.churn_prediction AS stored_churn_prediction,
  (CAST(p.churn_probability >= 0.5 AS INTEGER) = s.churn_prediction) AS matches_stored_prediction,
  s.model_name, s.model_version, s.model_alias
FROM mart m JOIN probs p ON p.customer_id = m.customer_id
LEFT JOIN scored s ON s.customer_id = m.customer_id
WHERE m.customer_id IN (SELECT c_custkey FROM customer)"""))
def rescore_compare(spark, sf):
    return V.rescore_compare(_all_customer_ids(spark, sf), mart_df(spark, sf), predictions_df(spark, sf))


@register("predict_batch", sql(*CHAIN, SCORED, body="""
SELECT customer_id AS record_id, CAST(churn_probability >= 0.5 AS INTEGER) AS churn_prediction,
  CASE WHEN churn_probability >= 0.5 THEN 'churn' ELSE 'no_churn' END AS prediction_label,
  model_name, model_version, model_alias
FROM scored"""))
def predict_batch(spark, sf):
    records = mart_df(spark, sf).select(F.col("customer_id").alias("record_id"), *_FEATS.split(", "))
    return V.predict_batch(records)


@register("customer_list_keyset", sql(*CHAIN, SCORED, body=_LIST_SQL.format(
    where="WHERE s.risk_band = 'High'", limit=10, offset=10)))
def customer_list_keyset(spark, sf):
    """Second High page through the keyset cursor (last row of page one)."""
    preds, m = predictions_df(spark, sf), mart_df(spark, sf)
    first = V.customer_list(preds, m, "High", 10, 0)
    last = (first.orderBy(F.col("churn_probability").asc(), F.col("customer_id").desc()).limit(1)
            .select(F.struct("churn_probability", "customer_id").alias("c")).scalar())
    page = V.customer_list_after(preds, m, last["churn_probability"], last["customer_id"], "High", 10)
    return round_doubles(page)
