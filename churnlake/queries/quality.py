"""Data-quality queries over the three layers and the prediction frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import quality as Q
from churnlake.oracle import CHAIN, SCORED, sql
from churnlake.queries.common import mart_df, predictions_df, raw_df, staging_df
from churnlake.registry import register
from churnlake.schemas import ACCEPTED_LABELS, FEATURE_COLUMNS, MART_WIDTH, RAW_SCHEMA

_REL = {"raw": "raw", "staging": "stg", "mart": "mart"}


def _column(layer: str, name: str):
    """A layer's column over the raw rows: staging is a projection of raw, and the mart one of staging."""
    from churnlake.plans.layers import staging_columns
    return F.col(name) if layer == "raw" else staging_columns()[name]


def _nn_sql():
    parts = []
    for layer, cols in Q.NOT_NULL_TESTS.items():
        for c in cols:
            parts.append(f"SELECT '{layer}' AS layer, '{c}' AS column_name, 'not_null' AS test, "
                         f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failures FROM {_REL[layer]}")
    return "\nUNION ALL\n".join(parts)


@register("dq_not_null", sql(*CHAIN, body=_nn_sql()))
def dq_not_null(spark, sf):
    # all layers are projections of the raw rows: one scan of the order history
    return Q.not_null_tests(raw_df(spark, sf), [
        (layer, c, _column(layer, c)) for layer, cols in Q.NOT_NULL_TESTS.items() for c in cols])


def _unique_sql():
    parts = []
    for layer, k in Q.UNIQUE_TESTS.items():
        parts.append(f"""SELECT '{layer}' AS layer, '{k}' AS column_name, 'unique' AS test,
  CAST(count(*) AS BIGINT) AS failures, CAST(coalesce(sum(n), 0) AS BIGINT) AS failing_rows
FROM (SELECT {k}, count(*) AS n FROM {_REL[layer]} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1)""")
    return "\nUNION ALL\n".join(parts)


@register("dq_unique", sql(*CHAIN, body=_unique_sql()))
def dq_unique(spark, sf):
    return Q.value_tests(raw_df(spark, sf), [
        (layer, k, _column(layer, k), None) for layer, k in Q.UNIQUE_TESTS.items()], "unique")


def _accepted_sql():
    parts = []
    for layer, tests in Q.ACCEPTED_VALUE_TESTS.items():
        for c, vals in tests.items():
            lst = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in vals)
            parts.append(f"""SELECT '{layer}' AS layer, '{c}' AS column_name, 'accepted_values' AS test,
  CAST(count(*) AS BIGINT) AS failures, CAST(coalesce(sum(n), 0) AS BIGINT) AS failing_rows
FROM (SELECT {c}, count(*) AS n FROM {_REL[layer]} WHERE {c} IS NOT NULL AND {c} NOT IN ({lst}) GROUP BY {c})""")
    return "\nUNION ALL\n".join(parts)


@register("dq_accepted_values", sql(*CHAIN, body=_accepted_sql()))
def dq_accepted_values(spark, sf):
    return Q.value_tests(raw_df(spark, sf), [
        (layer, c, _column(layer, c), values) for layer, tests in Q.ACCEPTED_VALUE_TESTS.items()
        for c, values in tests.items()], "accepted_values")


_RAW_COLS = RAW_SCHEMA.names


@register("null_profile", sql(*CHAIN, body="\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM raw"
    for i, c in enumerate(_RAW_COLS, 1))))
def null_profile(spark, sf):
    return Q.null_profile(raw_df(spark, sf))


_PROF = f"""
prof AS (
  SELECT CAST(count(*) AS BIGINT) AS rows, CAST({len(_RAW_COLS)} AS BIGINT) AS columns,
    CAST(count(DISTINCT client_num) AS BIGINT) AS unique_customers,
    CAST(count(*) - count(DISTINCT client_num) - max(CAST(client_num IS NULL AS INTEGER)) AS BIGINT) AS duplicate_customers,
    CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _RAW_COLS)} AS BIGINT) AS total_nulls
  FROM raw),
dom AS (
  SELECT CAST(count(*) AS BIGINT) AS target_values,
    CAST(count(*) FILTER (WHERE v IS NULL OR v NOT IN ('{ACCEPTED_LABELS[0]}', '{ACCEPTED_LABELS[1]}')) AS BIGINT) AS unexpected_target_values,
    CAST(2 - count(*) FILTER (WHERE v IN ('{ACCEPTED_LABELS[0]}', '{ACCEPTED_LABELS[1]}')) AS BIGINT) AS missing_target_values
  FROM (SELECT attrition_flag AS v FROM raw GROUP BY attrition_flag))"""


@register("ingestion_profile", sql(*CHAIN, _PROF, body="""
SELECT measure, value FROM (SELECT * FROM prof, dom)
UNPIVOT (value FOR measure IN (rows, columns, unique_customers, duplicate_customers, total_nulls,
  target_values, unexpected_target_values, missing_target_values))"""))
def ingestion_profile(spark, sf):
    return Q.ingestion_profile(raw_df(spark, sf))


@register("layer_reconciliation", sql(*CHAIN, body="""
SELECT 'raw' AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT client_num) AS BIGINT) AS unique_customers,
  CAST(count(*) FILTER (WHERE attrition_flag = 'Attrited Customer') AS BIGINT) AS churn_customers FROM raw
UNION ALL
SELECT 'staging', CAST(count(*) AS BIGINT), CAST(count(DISTINCT customer_id) AS BIGINT),
  CAST(count(*) FILTER (WHERE churn_flag = 1) AS BIGINT) FROM stg
UNION ALL
SELECT 'mart', CAST(count(*) AS BIGINT), CAST(count(DISTINCT customer_id) AS BIGINT),
  CAST(count(*) FILTER (WHERE churn_flag = 1) AS BIGINT) FROM mart"""))
def layer_reconciliation(spark, sf):
    return Q.layer_reconciliation(raw_df(spark, sf), [
        ("raw", F.col("client_num"), F.col("attrition_flag") == ACCEPTED_LABELS[1]),
        ("staging", _column("staging", "customer_id"), _column("staging", "churn_flag") == 1),
        ("mart", _column("mart", "customer_id"), _column("mart", "churn_flag") == 1)])


@register("dq_prediction_constraints", sql(*CHAIN, SCORED, body="""
SELECT constraint_name, violations FROM (
  SELECT 'pk_null' AS constraint_name, CAST(count(*) FILTER (WHERE customer_id IS NULL) AS BIGINT) AS violations FROM scored
  UNION ALL SELECT 'pk_duplicate', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
    FROM (SELECT customer_id, count(*) AS n FROM scored WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) > 1)
  UNION ALL SELECT 'chk_churn_probability', CAST(count(*) FILTER (WHERE churn_probability < 0 OR churn_probability > 1) AS BIGINT) FROM scored
  UNION ALL SELECT 'chk_churn_prediction', CAST(count(*) FILTER (WHERE churn_prediction NOT IN (0, 1)) AS BIGINT) FROM scored
  UNION ALL SELECT 'chk_risk_band', CAST(count(*) FILTER (WHERE risk_band NOT IN ('Low', 'Medium', 'High')) AS BIGINT) FROM scored)"""))
def dq_prediction_constraints(spark, sf):
    return Q.prediction_constraints(predictions_df(spark, sf))


@register("dq_scoring", sql(*CHAIN, SCORED, body="""
SELECT expectation, failures FROM (
  SELECT
    CAST(count(*) - count(DISTINCT customer_id) - max(CAST(customer_id IS NULL AS INTEGER)) AS BIGINT) AS duplicate_ids,
    CAST(count(*) FILTER (WHERE customer_id IS NULL) AS BIGINT) AS null_ids,
    CAST(count(*) FILTER (WHERE churn_probability IS NULL OR isnan(churn_probability)) AS BIGINT) AS null_or_nan_probability,
    CAST(count(*) FILTER (WHERE NOT (churn_probability BETWEEN 0 AND 1)) AS BIGINT) AS probability_out_of_range,
    CAST(count(*) FILTER (WHERE risk_band IS NULL OR risk_band NOT IN ('Low', 'Medium', 'High')) AS BIGINT) AS unknown_band,
    CAST(count(DISTINCT model_version) - 1 AS BIGINT) AS extra_versions,
    CAST(count(DISTINCT model_alias) - 1 AS BIGINT) AS extra_aliases,
    CAST(count(*) FILTER (WHERE model_version <> 3) AS BIGINT) AS wrong_version,
    CAST(count(*) FILTER (WHERE model_alias <> 'champion') AS BIGINT) AS wrong_alias,
    CAST(abs(count(*) - (SELECT count(*) FROM mart)) AS BIGINT) AS row_count_mismatch
  FROM scored)
UNPIVOT (failures FOR expectation IN (duplicate_ids, null_ids, null_or_nan_probability, probability_out_of_range,
  unknown_band, extra_versions, extra_aliases, wrong_version, wrong_alias, row_count_mismatch))"""))
def dq_scoring(spark, sf):
    m = mart_df(spark, sf)
    return Q.scoring_expectations(predictions_df(spark, sf), expected_rows_from=m,
                                  model_version=3, model_alias="champion")


def _mart_kinds():
    from churnlake.schemas import CATEGORICAL_FEATURES, DOUBLE_FEATURES, MART_COLUMNS
    return [(c, "string" if c in CATEGORICAL_FEATURES else "double" if c in DOUBLE_FEATURES
             else "bigint" if c == "customer_id" else "int") for c in MART_COLUMNS]


@register("mart_columns", sql(*CHAIN, body="\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM mart" for i, (c, _) in enumerate(_mart_kinds(), 1))))
def mart_columns(spark, sf):
    """Every mart column in order, with its exact NULL and distinct counts."""
    return Q.column_counts(mart_df(spark, sf)).select("ordinal", "column_name", "null_count", "distinct_values")


def _audit_sql():
    parts = []
    for c, _ in _mart_kinds():
        if c in ("customer_id", "churn_flag"):
            continue
        parts.append(f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS distinct_values,
  coalesce(bool_and(lo = hi), false) AND count(*) < sum(n) AND count(DISTINCT lo) > 1 AS reproduces_label
FROM (SELECT {c}, min(churn_flag) AS lo, max(churn_flag) AS hi, count(*) AS n FROM mart WHERE churn_flag IS NOT NULL GROUP BY {c})""")
    body = "\nUNION ALL\n".join(parts)
    return sql(*CHAIN, f"""
a AS ({body})""", body=f"""
SELECT column_name, distinct_values, reproduces_label,
  contains(lower(column_name), 'naive_bayes') OR lower(column_name) = 'attrition_status' AS forbidden_name,
  (SELECT count(*) FROM a) = {MART_WIDTH - 2} AS width_ok FROM a""")


@register("leakage_audit", _audit_sql())
def leakage_audit(spark, sf):
    """Per feature: a forbidden name, or values that alone tell the label of every labelled customer."""
    return Q.leakage_audit(mart_df(spark, sf), MART_WIDTH)


@register("feature_catalogue", sql(*CHAIN, body="\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, '{k}' AS data_type, "
    f"'{'categorical' if k == 'string' else 'numeric'}' AS feature_kind, "
    f"CAST(count({c}) AS BIGINT) AS present_values, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM mart"
    for i, (c, k) in enumerate(_mart_kinds(), 1) if c not in ("customer_id", "churn_flag"))))
def feature_catalogue(spark, sf):
    m = mart_df(spark, sf)
    kinds = {f.name: (f.dataType.simpleString(), "categorical" if f.dataType.simpleString() == "string" else "numeric")
             for f in m.schema.fields}
    kind = F.create_map(*[x for c, (t, k) in kinds.items()
                          for x in (F.lit(c), F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")))])
    return Q.column_counts(m).filter(~F.col("column_name").isin("customer_id", "churn_flag")).select(
        "ordinal", "column_name", kind[F.col("column_name")]["t"].alias("data_type"),
        kind[F.col("column_name")]["k"].alias("feature_kind"), "present_values", "distinct_values")


#: Registered variants of a customer's record: name -> (field, Spark expression, SQL expression).
_VARIANTS = {
    "text_from_number": ("gender", lambda: F.col("customer_age"), "customer_age"),
    "text_from_object": ("gender", lambda: F.struct(F.col("customer_age").alias("a")), "struct_pack(a := customer_age)"),
    "text_from_boolean": ("card_category", lambda: F.col("customer_age") > 40, "customer_age > 40"),
    "integral_float": ("customer_age", lambda: F.col("customer_age").cast("double"), "CAST(customer_age AS DOUBLE)"),
    "broken_float": ("customer_age", lambda: F.col("customer_age") + F.lit(0.5).cast("double"),
                     "CAST(customer_age AS DOUBLE) + 0.5"),
    "integer_text": ("customer_age", lambda: F.col("customer_age").cast("string"), "CAST(customer_age AS VARCHAR)"),
    "float_text": ("customer_age", lambda: F.concat(F.col("customer_age").cast("string"), F.lit(".0")),
                   "CAST(customer_age AS VARCHAR) || '.0'"),
    "number_from_word": ("credit_limit", lambda: F.lit("high"), "'high'"),
}


def _contract_sql():
    """The contract stated on its own, on DuckDB's JSON types."""
    from churnlake.schemas import DOUBLE_FEATURES, INTEGER_FEATURES
    checks = []
    for f in FEATURE_COLUMNS:
        kind, text = f"json_type(record, '$.{f}')", f"json_extract_string(record, '$.{f}')"
        whole = f"CAST({text} AS DOUBLE) = floor(CAST({text} AS DOUBLE))"
        if f in INTEGER_FEATURES:
            good = (f"CASE WHEN {kind} IN ('BIGINT', 'UBIGINT') THEN TRY_CAST({text} AS INTEGER) IS NOT NULL "
                    f"WHEN {kind} = 'DOUBLE' THEN {whole} AND TRY_CAST(CAST({text} AS DOUBLE) AS INTEGER) IS NOT NULL "
                    f"WHEN {kind} = 'VARCHAR' THEN regexp_full_match({text}, '[-+]?[0-9]+') "
                    f"AND TRY_CAST({text} AS INTEGER) IS NOT NULL ELSE false END")
        elif f in DOUBLE_FEATURES:
            good = (f"CASE WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN true WHEN {kind} = 'VARCHAR' THEN "
                    f"regexp_full_match({text}, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') ELSE false END")
        else:
            good = f"{kind} = 'VARCHAR'"
        checks.append(f"CASE WHEN coalesce({kind}, 'NULL') = 'NULL' THEN 'missing:{f}' WHEN NOT ({good}) THEN 'type:{f}' END")
    known = ", ".join(f"'{f}'" for f in FEATURE_COLUMNS)

    def record(change=(None, None)):
        fields = ", ".join(f"{c} := {change[1] if c == change[0] else c}" for c in FEATURE_COLUMNS)
        return f"CAST(to_json(struct_pack({fields})) AS VARCHAR)"

    variants = "\n  UNION ALL\n  ".join(
        f"SELECT '{name}:' || CAST(customer_id AS VARCHAR), {record((field, text))} FROM mart"
        for name, (field, _, text) in _VARIANTS.items())
    return sql(*CHAIN, f"""
recs AS (
  SELECT 'customer:' || CAST(customer_id AS VARCHAR) AS record_id, {record()} AS record FROM mart
  UNION ALL
  {variants}
  UNION ALL
  SELECT 'event:' || CAST(event_id AS VARCHAR), props FROM events),
reasons AS (
  SELECT record_id, list_sort(list_concat(
      [x FOR x IN [{", ".join(checks)}] IF x IS NOT NULL],
      ['extra:' || k FOR k IN json_keys(record) IF NOT list_contains([{known}], k)])) AS r
  FROM recs)""", body="""
SELECT record_id, len(r) = 0 AS is_valid, CAST(len(r) AS INTEGER) AS n_reasons, array_to_string(r, ';') AS reasons
FROM reasons""")


@register("contract_quarantine", _contract_sql())
def contract_quarantine(spark, sf):
    """Records of all customers, each also with one field of another JSON type, and all event payloads."""
    from churnlake.sources.fixture import read_table
    m = mart_df(spark, sf)

    def record(field=None, value=None):
        return F.to_json(F.struct(*[value.alias(c) if c == field else F.col(c) for c in FEATURE_COLUMNS]))

    forms = [("customer", record())] + [(name, record(field, value())) for name, (field, value, _) in _VARIANTS.items()]
    recs = m.select("customer_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), text.alias("record")) for name, text in forms])).alias("f")).select(
        F.concat(F.col("f.name"), F.lit(":"), F.col("customer_id").cast("string")).alias("record_id"), "f.record")
    ev = read_table(spark, sf, "events").select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("record_id"),
        F.col("props").alias("record"))
    return Q.contract_check(recs.unionByName(ev)).select("record_id", "is_valid", "n_reasons", "reasons")


@register("dq_domain_equality", sql(*CHAIN, SCORED, body="""
SELECT 'attrition_flag' AS domain,
  CAST((SELECT count(*) FROM (SELECT DISTINCT attrition_flag FROM raw EXCEPT SELECT * FROM (VALUES ('Existing Customer'), ('Attrited Customer')))) AS BIGINT) AS unexpected_values,
  CAST((SELECT count(*) FROM (SELECT * FROM (VALUES ('Existing Customer'), ('Attrited Customer')) EXCEPT SELECT DISTINCT attrition_flag FROM raw)) AS BIGINT) AS missing_values
UNION ALL
SELECT 'risk_band',
  CAST((SELECT count(*) FROM (SELECT DISTINCT risk_band FROM scored EXCEPT SELECT * FROM (VALUES ('Low'), ('Medium'), ('High')))) AS BIGINT),
  CAST((SELECT count(*) FROM (SELECT * FROM (VALUES ('Low'), ('Medium'), ('High')) EXCEPT SELECT DISTINCT risk_band FROM scored)) AS BIGINT)"""))
def dq_domain_equality(spark, sf):
    from churnlake.schemas import RISK_BANDS
    out = None
    for name, df, col, expected in [("attrition_flag", raw_df(spark, sf), "attrition_flag", ACCEPTED_LABELS),
                                    ("risk_band", predictions_df(spark, sf), "risk_band", RISK_BANDS)]:
        row = Q.domain_comparison(spark, df.select(col), expected, name)
        out = row if out is None else out.unionByName(row)
    return out.select("domain", "unexpected_values", "missing_values")


@register("dq_portfolio", sql(*CHAIN, SCORED, body="""
SELECT count(*) FILTER (WHERE risk_band = 'Low') + count(*) FILTER (WHERE risk_band = 'Medium')
         + count(*) FILTER (WHERE risk_band = 'High') = count(*) AS bands_sum_to_total,
       min(model_version) = max(model_version) AS single_model_version,
       count(*) FILTER (WHERE risk_band = 'High') = coalesce(sum(churn_prediction), 0) AS high_equals_predicted
FROM scored"""))
def dq_portfolio(spark, sf):
    from churnlake.plans.serving import portfolio_summary
    s = portfolio_summary(predictions_df(spark, sf))
    return s.select(
        ((F.col("low_risk_customers") + F.col("medium_risk_customers") + F.col("high_risk_customers"))
         == F.col("total_customers")).alias("bands_sum_to_total"),
        (F.col("minimum_model_version") == F.col("maximum_model_version")).alias("single_model_version"),
        (F.col("high_risk_customers") == F.col("predicted_churn_customers")).alias("high_equals_predicted"))
