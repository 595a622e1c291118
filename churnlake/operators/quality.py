"""Data-quality operators (not_null / unique / accepted_values, profiles,
reconciliation, leakage, prediction constraints, record contract).

Every check of one layer collapses into one aggregation pass; results come
back as small expectation tables (one row per check) that a caller can
assert on with a single bounded ``collect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.functions.columns import with_row
from churnlake.schemas import (ACCEPTED_LABELS, FEATURE_COLUMNS, INTEGER_FEATURES,
                               DOUBLE_FEATURES, LEAK_EXACT, LEAK_SUBSTRING, RISK_BANDS)

# Declarative data tests per layer (fixed values: which column gets which test).
NOT_NULL_TESTS = {
    "raw": ["client_num", "attrition_flag"],
    "staging": ["customer_id", "attrition_status", "churn_flag", "credit_limit",
                "total_transaction_amount", "total_transaction_count"],
    "mart": ["customer_id", "churn_flag", "months_inactive_last_12m",
             "total_transaction_amount", "total_transaction_count"],
}
UNIQUE_TESTS = {"raw": "client_num", "staging": "customer_id", "mart": "customer_id"}
ACCEPTED_VALUE_TESTS = {
    "raw": {"attrition_flag": ACCEPTED_LABELS},
    "staging": {"attrition_status": ACCEPTED_LABELS, "churn_flag": [0, 1]},
    "mart": {"churn_flag": [0, 1]},
}


def not_null_failures(df: DataFrame, layer: str, columns: list[str]) -> DataFrame:
    """(layer, column_name, test, failures) for every column, one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "failures").select(
        F.lit(layer).alias("layer"), "column_name", F.lit("not_null").alias("test"), "failures")


def unique_failures(df: DataFrame, layer: str, key: str) -> DataFrame:
    """Key values that occur more than once (NULL keys are ignored, as the
    declarative test does). Partial aggregation keeps a hot key small."""
    dup = (df.select(key).filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    return dup.agg(F.count(F.lit(1)).cast("bigint").alias("failures"),
                   F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("failing_rows")).select(
        F.lit(layer).alias("layer"), F.lit(key).alias("column_name"),
        F.lit("unique").alias("test"), "failures", "failing_rows")


def accepted_values_failures(df: DataFrame, layer: str, column: str, values: list) -> DataFrame:
    """Distinct values outside the accepted list (NULL passes)."""
    c = F.col(column)
    bad = (df.select(column).filter(c.isNotNull() & ~c.isin(values))
           .groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    return bad.agg(F.count(F.lit(1)).cast("bigint").alias("failures"),
                   F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("failing_rows")).select(
        F.lit(layer).alias("layer"), F.lit(column).alias("column_name"),
        F.lit("accepted_values").alias("test"), "failures", "failing_rows")


def not_null_tests(frame: DataFrame, tests: list[tuple[str, str, F.Column]]) -> DataFrame:
    """(layer, column_name, test, failures) for (layer, column, expression)
    tests that all read one frame: a single aggregation pass, however many
    layers are projections of that frame."""
    counts = frame.agg(*[F.count_if(expr.isNull()).cast("bigint").alias(f"t{i}")
                         for i, (_, _, expr) in enumerate(tests)])
    key = F.create_map(*[x for i, (layer, col, _) in enumerate(tests)
                         for x in (F.lit(f"t{i}"), F.struct(F.lit(layer).alias("layer"),
                                                             F.lit(col).alias("column_name")))])
    long = counts.unpivot([], [f"t{i}" for i in range(len(tests))], "k", "failures")
    return long.select(key[F.col("k")]["layer"].alias("layer"), key[F.col("k")]["column_name"].alias("column_name"),
                       F.lit("not_null").alias("test"), "failures")


def value_tests(frame: DataFrame, tests: list[tuple[str, str, F.Column, list | None]], test: str) -> DataFrame:
    """(layer, column_name, test, failures, failing_rows) for (layer, column,
    expression, accepted values) tests that all read one frame, in one pass.

    With accepted values a failure is a distinct value outside them, without
    (None) it is a value that occurs more than once. NULL passes either way.
    Rows are counted per (test, value) with partial aggregation first."""
    long = frame.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), expr.cast("string").alias("v")) for i, (_, _, expr, _) in enumerate(tests)
    ])).alias("kv")).select("kv.*").filter(F.col("v").isNotNull())
    per = long.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    one = []
    for i, (_, _, _, accepted) in enumerate(tests):
        bad = F.col("n") > 1 if accepted is None else ~F.col("v").isin([str(x) for x in accepted])
        hit = (F.col("t") == i) & bad
        one += [F.count_if(hit).cast("bigint").alias(f"f{i}"),
                F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias(f"r{i}")]
    return per.agg(*one).select(F.explode(F.array(*[
        F.struct(F.lit(layer).alias("layer"), F.lit(column).alias("column_name"), F.lit(test).alias("test"),
                 F.col(f"f{i}").alias("failures"), F.col(f"r{i}").alias("failing_rows"))
        for i, (layer, column, _, _) in enumerate(tests)])).alias("kv")).select("kv.*")


def duplicate_rows(key: str) -> F.Column:
    """Rows beyond the first of each key, where NULL keys count as one key
    (pandas ``duplicated``): rows - distinct non-null keys - [any NULL key]."""
    return (F.count(F.lit(1)) - F.count_distinct(F.col(key))
            - F.max(F.col(key).isNull().cast("int"))).cast("bigint")


def null_profile(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, null_count) for every column in one pass."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    ordinals = F.create_map(*[x for i, c in enumerate(cols, 1) for x in (F.lit(c), F.lit(i))])
    return counts.unpivot([], cols, "column_name", "null_count").select(
        ordinals[F.col("column_name")].alias("ordinal"), "column_name", "null_count")


def ingestion_profile(raw: DataFrame, key: str = "client_num", label: str = "attrition_flag",
                      expected_labels: list[str] = ACCEPTED_LABELS) -> DataFrame:
    """Long (measure, value) profile of the raw snapshot.

    rows, columns, unique ids, duplicate ids, NULL cells over all columns,
    and the label domain compared with the expected set (distinct count,
    unexpected values, missing expected values), all exact, in one pass."""
    total_nulls = None
    for c in raw.columns:
        term = F.count_if(F.col(c).isNull())
        total_nulls = term if total_nulls is None else total_nulls + term
    lab = F.col(label)
    any_null = F.coalesce(F.max(lab.isNull().cast("int")), F.lit(0))
    one = raw.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("columns"),
        F.count_distinct(F.col(key)).cast("bigint").alias("unique_customers"),
        duplicate_rows(key).alias("duplicate_customers"),
        total_nulls.cast("bigint").alias("total_nulls"),
        (F.count_distinct(lab) + any_null).cast("bigint").alias("target_values"),
        (F.count_distinct(F.when(~lab.isin(expected_labels), lab)) + any_null)
        .cast("bigint").alias("unexpected_target_values"),
        (F.lit(len(expected_labels)) - sum((F.coalesce(F.max((lab == x).cast("int")), F.lit(0))
                                            for x in expected_labels), F.lit(0)))
        .cast("bigint").alias("missing_target_values"),
    )
    measures = ["rows", "columns", "unique_customers", "duplicate_customers", "total_nulls",
                "target_values", "unexpected_target_values", "missing_target_values"]
    return one.unpivot([], measures, "measure", "value")


def layer_reconciliation(frame: DataFrame, layers: list[tuple[str, F.Column, F.Column]]) -> DataFrame:
    """(dataset, rows, unique_customers, churn_customers) of layers that are
    projections of one frame, given as (name, key, churned): one pass."""
    one = frame.agg(*[x for i, (_, key, churn) in enumerate(layers) for x in (
        F.count(F.lit(1)).cast("bigint").alias(f"n{i}"), F.count_distinct(key).cast("bigint").alias(f"u{i}"),
        F.count_if(churn).cast("bigint").alias(f"c{i}"))])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("dataset"), F.col(f"n{i}").alias("rows"),
                 F.col(f"u{i}").alias("unique_customers"), F.col(f"c{i}").alias("churn_customers"))
        for i, (name, _, _) in enumerate(layers)])).alias("kv")).select("kv.*")


def reconciliation_verdict(recon: DataFrame) -> DataFrame:
    """One row: each measure must take a single value across the layers."""
    return recon.agg(*[(F.count_distinct(c) == 1).alias(f"{c}_match")
                       for c in ("rows", "unique_customers", "churn_customers")])


def source_measures(df: DataFrame, key: str, label: str) -> DataFrame:
    lab = F.col(label)
    wide = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_distinct(F.col(key)).cast("bigint").alias("unique_customers"),
        F.count_if(lab == ACCEPTED_LABELS[0]).cast("bigint").alias("existing_customers"),
        F.count_if(lab == ACCEPTED_LABELS[1]).cast("bigint").alias("attrited_customers"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def reconcile_sources(a: DataFrame, b: DataFrame, name_a: str = "file_source",
                      name_b: str = "table_source", key: str = "client_num",
                      label: str = "attrition_flag") -> DataFrame:
    """Align the measures of two systems by name and compare (NULL-safe)."""
    ma = source_measures(a, key, label).withColumnRenamed("value", name_a)
    mb = source_measures(b, key, label).withColumnRenamed("value", name_b)
    j = ma.join(mb, "metric", "full_outer")
    return j.select("metric", name_a, name_b, F.col(name_a).eqNullSafe(F.col(name_b)).alias("matches"))


def column_counts(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, null_count, present_values, distinct_values) of
    every column: values are counted per (column, value) with partial
    aggregation, one pass over the rows."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(df.columns, 1)])).alias("kv")).select("kv.*")
    per = long.groupBy("ordinal", "column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("ordinal", "column_name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("present_values"),
        F.count_if(F.col("v").isNotNull()).cast("bigint").alias("distinct_values"))


def leakage_audit(mart: DataFrame, expected_width: int, label: str = "churn_flag",
                  key: str = "customer_id") -> DataFrame:
    """(column_name, distinct_values, reproduces_label, forbidden_name, width_ok)
    per feature. ``reproduces_label``: every value (NULL is one) occurs with
    one label only, values repeat, and both labels occur, so the column alone
    tells the label; labelled rows count."""
    features = [c for c in mart.columns if c not in (label, key)]
    long = mart.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in features])).alias("kv")) \
        .select("y", "kv.*")
    per = long.groupBy("column_name", "v").agg(
        F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n"))
    name = F.lower(F.col("column_name"))
    return per.groupBy("column_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("distinct_values"),
        (F.coalesce(F.bool_and(F.col("lo") == F.col("hi")), F.lit(False)) & (F.count(F.lit(1)) < F.sum("n"))
         & (F.min("lo") < F.max("lo"))).alias("reproduces_label")).select(
        "column_name", "distinct_values", "reproduces_label",
        (name.contains(LEAK_SUBSTRING) | (name == LEAK_EXACT)).alias("forbidden_name"),
        F.lit(len(mart.columns) == expected_width).alias("width_ok"))


def prediction_constraints(pred: DataFrame) -> DataFrame:
    """Violations of the prediction mart's key and CHECK constraints.

    CHECKs pass on NULL (SQL semantics); the key must be non-NULL and unique."""
    p, y, b = F.col("churn_probability"), F.col("churn_prediction"), F.col("risk_band")
    checks = pred.agg(
        F.count_if(F.col("customer_id").isNull()).cast("bigint").alias("pk_null"),
        F.count_if((p < 0) | (p > 1)).cast("bigint").alias("chk_churn_probability"),
        F.count_if(~y.isin(0, 1)).cast("bigint").alias("chk_churn_prediction"),
        F.count_if(~b.isin(RISK_BANDS)).cast("bigint").alias("chk_risk_band"),
    )
    dups = (pred.select("customer_id").filter(F.col("customer_id").isNotNull())
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("pk_duplicate")))
    wide = with_row(checks, dups)
    return wide.unpivot([], ["pk_null", "pk_duplicate", "chk_churn_probability",
                             "chk_churn_prediction", "chk_risk_band"], "constraint_name", "violations")


def scoring_expectations(pred: DataFrame, expected_rows_from: DataFrame | None = None,
                         model_version: int | None = None, model_alias: str | None = None) -> DataFrame:
    """Scoring-output asserts as (expectation, failures) rows: one row per
    customer, ids and probabilities present and finite, probability in
    [0,1], band in the domain, one version, one alias."""
    p = F.col("churn_probability")
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        duplicate_rows("customer_id").alias("duplicate_ids"),
        F.count_if(F.col("customer_id").isNull()).cast("bigint").alias("null_ids"),
        F.count_if(p.isNull() | F.isnan(p)).cast("bigint").alias("null_or_nan_probability"),
        F.count_if(~p.between(0, 1)).cast("bigint").alias("probability_out_of_range"),
        F.count_if(~F.col("risk_band").isin(RISK_BANDS) | F.col("risk_band").isNull())
        .cast("bigint").alias("unknown_band"),
        (F.count_distinct("model_version") - 1).cast("bigint").alias("extra_versions"),
        (F.count_distinct("model_alias") - 1).cast("bigint").alias("extra_aliases"),
    ]
    if model_version is not None:
        aggs.append(F.count_if(F.col("model_version") != model_version).cast("bigint").alias("wrong_version"))
    if model_alias is not None:
        aggs.append(F.count_if(F.col("model_alias") != model_alias).cast("bigint").alias("wrong_alias"))
    wide = pred.agg(*aggs)
    names = [c for c in wide.columns if c != "rows"]
    if expected_rows_from is not None:
        exp = expected_rows_from.agg(F.count(F.lit(1)).alias("_expected"))
        wide = with_row(wide, exp).withColumn(
            "row_count_mismatch", F.abs(F.col("rows") - F.col("_expected")).cast("bigint"))
        names.append("row_count_mismatch")
    return wide.unpivot([], names, "expectation", "failures")


def threshold_expectations(thresholds: DataFrame) -> DataFrame:
    """``0 < watchlist < classification < 1`` on a one-row threshold frame."""
    w, c = F.col("watchlist_threshold"), F.col("classification_threshold")
    return thresholds.select(
        (w > 0).alias("watchlist_positive"),
        (w < c).alias("watchlist_below_classification"),
        (c < 1).alias("classification_below_one"),
    )


# --- record contract (19 typed fields, unknown fields refused) -------------

_INT_PATTERN = r"^[+-]?[0-9]+$"
_FLOAT_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _integral(v, kind):
    """JSON integer, integral JSON number ('5.0' and 5e1 too), or text of an integer; NULL when it is none."""
    number = F.try_variant_get(v, "$", "double")
    return (F.when(kind.startswith("BIGINT"), F.try_variant_get(v, "$", "int"))
            .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & (number == F.floor(number)), number.try_cast("int"))
            .when((kind == "STRING") & F.try_variant_get(v, "$", "string").rlike(_INT_PATTERN),
                  F.try_variant_get(v, "$", "string").try_cast("int")))


def _floating(v, kind):
    """JSON number, or text of a number; NULL when it is neither."""
    return (F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
            .when((kind == "STRING") & F.try_variant_get(v, "$", "string").rlike(_FLOAT_PATTERN),
                  F.try_variant_get(v, "$", "string").try_cast("double")))


def contract_check(records: DataFrame, text_col: str = "record", id_col: str = "record_id") -> DataFrame:
    """Split JSON feature records into valid / quarantined with reasons.

    The JSON type of each value counts, not only its text. Reasons (sorted,
    ';'-joined): ``missing:<f>`` for an absent or null field, ``type:<f>``
    for a value of another type (text fields take JSON strings only; integer
    fields integers, integral numbers and text of an integer; decimal fields
    numbers and text of a number; booleans, objects and arrays fit nowhere),
    ``extra:<k>`` for an unknown key, ``not_an_object`` for text that is not
    a JSON object. Valid records carry the typed 19 features."""
    doc = F.try_parse_json(F.col(text_col))
    m = F.from_json(F.col(text_col), T.MapType(T.StringType(), T.StringType()))
    parsed = records.select(F.col(id_col), F.map_keys(m).alias("_keys"),
                            F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)).alias("_object"),
                            *[F.try_variant_get(doc, f"$.{f}", "variant").alias(f"_v_{f}") for f in FEATURE_COLUMNS])
    kinds = parsed.select("*", *[F.schema_of_variant(f"_v_{f}").alias(f"_k_{f}") for f in FEATURE_COLUMNS])
    typed = []
    for f in FEATURE_COLUMNS:
        v, kind = F.col(f"_v_{f}"), F.col(f"_k_{f}")
        if f in INTEGER_FEATURES:
            typed.append(_integral(v, kind).alias(f))
        elif f in DOUBLE_FEATURES:
            typed.append(_floating(v, kind).alias(f))
        else:
            typed.append(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias(f))
    cast = kinds.select(id_col, "_keys", "_object", *[f"_k_{f}" for f in FEATURE_COLUMNS], *typed)
    checks = [F.when(F.col(f"_k_{f}").isNull() | (F.col(f"_k_{f}") == "VOID"), F.lit(f"missing:{f}"))
              .when(F.col(f).isNull(), F.lit(f"type:{f}")) for f in FEATURE_COLUMNS]
    known = F.array(*[F.lit(f) for f in FEATURE_COLUMNS])
    extras = F.transform(F.filter(F.col("_keys"), lambda k: ~F.array_contains(known, k)),
                         lambda k: F.concat(F.lit("extra:"), k))
    reasons = F.when(~F.col("_object"), F.array(F.lit("not_an_object"))).otherwise(
        F.array_sort(F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), extras)))
    out = cast.select(id_col, reasons.alias("_r"), *FEATURE_COLUMNS)
    return out.select(
        F.col(id_col), (F.size("_r") == 0).alias("is_valid"),
        F.size("_r").alias("n_reasons"), F.array_join("_r", ";").alias("reasons"),
        *FEATURE_COLUMNS)


def domain_comparison(spark: SparkSession, values: DataFrame, expected: list, name: str) -> DataFrame:
    """Set comparison of a column's distinct values with an expected domain:
    unexpected (observed minus expected) and missing (expected minus
    observed). Equality = both zero; subset = no unexpected values."""
    col = values.columns[0]
    observed = values.select(F.col(col).alias("v")).distinct()
    exp = spark.createDataFrame([(e,) for e in expected], T.StructType(
        [T.StructField("v", values.schema[col].dataType)]))
    unexpected = observed.subtract(exp).agg(F.count(F.lit(1)).cast("bigint").alias("unexpected_values"))
    missing = exp.subtract(observed).agg(F.count(F.lit(1)).cast("bigint").alias("missing_values"))
    return with_row(unexpected, missing).select(F.lit(name).alias("domain"), "unexpected_values", "missing_values")
