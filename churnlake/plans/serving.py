"""Read queries behind the dashboard, as DataFrame functions (V1-V5).

Each function takes the prediction mart and/or the model mart as
DataFrames and returns a DataFrame; batch forms replace single-id calls
(a keys DataFrame instead of one id), so the same plan serves one customer
or the whole portfolio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.columns import prediction_label, threshold_predict, with_row
from churnlake.plans.scoring import Scorer, fixed_scorer
from churnlake.schemas import (DEFAULT_PREDICT_THRESHOLD, FEATURE_COLUMNS, MODEL_ALIAS,
                               MODEL_NAME, MODEL_VERSION, RISK_BANDS)

MAX_PAGE = 100
DEFAULT_PAGE = 10


def portfolio_summary(predictions: DataFrame) -> DataFrame:
    """One KPI row in a single aggregation pass (partial + final)."""
    band = F.col("risk_band")
    return predictions.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.coalesce(F.sum("churn_prediction"), F.lit(0)).cast("bigint")
        .alias("predicted_churn_customers"),
        F.coalesce(F.avg(F.col("churn_prediction").cast("double")), F.lit(0.0))
        .alias("predicted_churn_rate"),
        F.coalesce(F.avg("churn_probability"), F.lit(0.0)).alias("average_churn_probability"),
        F.count_if(band == RISK_BANDS[0]).cast("bigint").alias("low_risk_customers"),
        F.count_if(band == RISK_BANDS[1]).cast("bigint").alias("medium_risk_customers"),
        F.count_if(band == RISK_BANDS[2]).cast("bigint").alias("high_risk_customers"),
        F.min("model_version").cast("bigint").alias("minimum_model_version"),
        F.max("model_version").cast("bigint").alias("maximum_model_version"),
        F.max("model_alias").alias("model_alias"),
        F.max("scored_at").alias("latest_scoring_at"),
    )


def _check_page(risk_band, limit, offset):
    if risk_band is not None and risk_band not in RISK_BANDS:
        raise ValueError(f"risk_band must be one of {RISK_BANDS} or None, got {risk_band!r}")
    if not isinstance(limit, int) or not (1 <= limit <= MAX_PAGE):
        raise ValueError(f"limit must be an integer in [1, {MAX_PAGE}], got {limit!r}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError(f"offset must be a non-negative integer, got {offset!r}")


def check_page_requests(requests: DataFrame) -> DataFrame:
    """(request_id, risk_band, limit, offset, is_valid, reasons) of a table of page requests, all as text.

    The same contract as a single call: an absent band means all, an absent
    limit 10, an absent offset 0; the band is one of the three, the limit an
    integer from 1 to MAX_PAGE, the offset an integer of at least 0. Reasons
    name the fields at fault, ';'-joined; a field at fault is NULL.
    """
    whole = lambda c: F.when(F.col(c).rlike("^[+-]?[0-9]+$"), F.col(c).try_cast("bigint"))
    rows = requests.select(
        "request_id", "risk_band", F.coalesce("limit", F.lit(str(DEFAULT_PAGE))).alias("limit"),
        F.coalesce("offset", F.lit("0")).alias("offset"))
    limit, offset = whole("limit"), whole("offset")
    checks = {"limit": limit.between(1, MAX_PAGE), "offset": offset >= 0,
              "risk_band": F.col("risk_band").isNull() | F.col("risk_band").isin(RISK_BANDS)}
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    reasons = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in ok.items()]))
    return rows.select("request_id", F.when(ok["risk_band"], F.col("risk_band")).alias("risk_band"),
                       F.when(ok["limit"], limit).alias("limit"), F.when(ok["offset"], offset).alias("offset"),
                       (F.size(reasons) == 0).alias("is_valid"), F.array_join(reasons, ";").alias("reasons"))


def _band_filter(predictions: DataFrame, risk_band):
    # The predicate is only built when a band is given, so it stays a plain
    # equality that reaches the scan instead of an OR on a parameter.
    return predictions if risk_band is None else predictions.filter(F.col("risk_band") == risk_band)


def _page_order():
    return [F.col("churn_probability").desc_nulls_first(), F.col("customer_id").asc()]


_PAGE_COLUMNS = ["customer_id", "customer_age", "gender", "churn_probability", "risk_band",
                 "churn_prediction", "model_version", "model_alias", "scored_at"]


def customer_list(predictions: DataFrame, mart: DataFrame, risk_band: str | None = None,
                  limit: int = 10, offset: int = 0) -> DataFrame:
    """One page ordered by probability (NULL first, like the source system)
    then id, over predictions that have a mart row (inner join).

    Both sides are pruned to the listed columns and the band before one join
    on the customer key, whose strategy Spark picks by measured size; the
    page is a per-task top-k of ``limit + offset`` rows. A deep page is
    cheaper with ``customer_list_after``."""
    _check_page(risk_band, limit, offset)
    people = mart.select("customer_id", "customer_age", "gender")
    page = _band_filter(predictions, risk_band).join(people, "customer_id").orderBy(*_page_order())
    if offset:
        page = page.offset(offset)
    return page.limit(limit).select(*_PAGE_COLUMNS)


def customer_list_after(predictions: DataFrame, mart: DataFrame, after_probability: float,
                        after_customer_id: int, risk_band: str | None = None,
                        limit: int = 10) -> DataFrame:
    """Keyset cursor for deep pages: rows strictly after ``(p, id)`` in page
    order, so a deep page costs a top-``limit`` and not ``limit + offset``."""
    _check_page(risk_band, limit, 0)
    p, cid = F.col("churn_probability"), F.col("customer_id")
    ap = after_probability if isinstance(after_probability, Column) else F.lit(after_probability)
    aid = after_customer_id if isinstance(after_customer_id, Column) else F.lit(after_customer_id)
    after = (p < ap) | ((p == ap) & (cid > aid))
    preds = _band_filter(predictions, risk_band).filter(after)
    return customer_list(preds, mart, None, limit, 0)


def customer_list_total(predictions: DataFrame, risk_band: str | None = None) -> DataFrame:
    """Matching predictions *without* the mart join (an orphan prediction is
    counted but never listed, as in the source system)."""
    _check_page(risk_band, 1, 0)
    return _band_filter(predictions, risk_band).agg(F.count(F.lit(1)).cast("bigint").alias("total_matching"))


def customer_list_header(predictions: DataFrame, mart: DataFrame, risk_band: str | None = None,
                         limit: int = 10, offset: int = 0) -> DataFrame:
    page = customer_list(predictions, mart, risk_band, limit, offset)
    returned = page.agg(F.count(F.lit(1)).cast("bigint").alias("returned_count"))
    total = customer_list_total(predictions, risk_band)
    return with_row(total, returned).select(
        F.lit(risk_band).cast("string").alias("risk_band"), "total_matching", "returned_count",
        F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


_PREDICTION_FIELDS = ["churn_probability", "risk_band", "churn_prediction", "model_name",
                      "model_version", "model_alias", "scored_at", "scoring_run_id"]


def customer_details(ids: DataFrame, mart: DataFrame, predictions: DataFrame) -> DataFrame:
    """Batch profile lookup: features nested in one struct and the stored
    prediction in a nullable struct. Ids without a mart row come back as
    not-found rows (``found = false``) instead of an error."""
    if "scoring_run_id" not in predictions.columns:
        predictions = predictions.withColumn("scoring_run_id", F.lit(None).cast("string"))
    keys = ids.select(F.col("customer_id").cast("bigint").alias("customer_id")).distinct()
    # Reduce the big tables to the requested keys first: a semi join lets
    # AQE broadcast a small key batch (no shuffle of mart or predictions);
    # the outer joins then only see rows that belong to the batch.
    model = (mart.select("customer_id", *FEATURE_COLUMNS).join(keys, "customer_id", "left_semi")
             .withColumn("_found", F.lit(True)))
    preds = predictions.select("customer_id", *_PREDICTION_FIELDS).join(keys, "customer_id", "left_semi")
    joined = keys.join(model, "customer_id", "left").join(preds, "customer_id", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.select(
        "customer_id",
        found.alias("found"),
        F.when(found, F.struct(*FEATURE_COLUMNS)).alias("features"),
        F.when(F.col("churn_prediction").isNotNull(), F.struct(*_PREDICTION_FIELDS)).alias("prediction"),
    )


def flatten_details(details: DataFrame) -> DataFrame:
    """Flat view of ``customer_details`` (features.*, prediction_*)."""
    return details.select(
        "customer_id", "found",
        *[F.col(f"features.{c}").alias(c) for c in FEATURE_COLUMNS],
        *[F.col(f"prediction.{c}").alias(f"stored_{c}") for c in _PREDICTION_FIELDS])


def rescore_compare(ids: DataFrame, mart: DataFrame, predictions: DataFrame,
                    scorer: Scorer = fixed_scorer,
                    threshold: float = DEFAULT_PREDICT_THRESHOLD,
                    model_name: str = MODEL_NAME, model_version: int = MODEL_VERSION,
                    model_alias: str = MODEL_ALIAS) -> DataFrame:
    """Fresh prediction (model's own cut, 0.5) next to the stored one.

    ``matches_stored_prediction`` is a plain ``=``: NULL when nothing is
    stored. Stored predictions use the official cut, so customers with
    official <= p < 0.5 deliberately mismatch."""
    keys = ids.select(F.col("customer_id").cast("bigint").alias("customer_id")).distinct()
    found = mart.join(keys, "customer_id", "left_semi")
    fresh = scorer(found).select("customer_id",
                                 threshold_predict("churn_probability", threshold).alias("churn_prediction"))
    stored = (predictions.join(keys, "customer_id", "left_semi")
              .select("customer_id", F.col("churn_prediction").alias("stored_churn_prediction")))
    out = fresh.join(stored, "customer_id", "left")
    return out.select(
        "customer_id", "churn_prediction",
        prediction_label("churn_prediction").alias("prediction_label"),
        "stored_churn_prediction",
        (F.col("churn_prediction") == F.col("stored_churn_prediction")).alias("matches_stored_prediction"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).cast("int").alias("model_version"),
        F.lit(model_alias).alias("model_alias"),
    )


def predict_batch(records: DataFrame, scorer: Scorer = fixed_scorer,
                  threshold: float = DEFAULT_PREDICT_THRESHOLD,
                  model_name: str = MODEL_NAME, model_version: int = MODEL_VERSION,
                  model_alias: str = MODEL_ALIAS, id_column: str = "record_id") -> DataFrame:
    """Score already-validated feature records (see
    ``quality.contract_quarantine`` for the typed split)."""
    keyed = records.withColumnRenamed(id_column, "customer_id")
    scored = scorer(keyed)
    return scored.select(
        F.col("customer_id").alias(id_column),
        threshold_predict("churn_probability", threshold).alias("churn_prediction"),
    ).select(
        id_column, "churn_prediction",
        prediction_label("churn_prediction").alias("prediction_label"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).cast("int").alias("model_version"),
        F.lit(model_alias).alias("model_alias"),
    )
