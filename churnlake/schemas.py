"""Layer schemas, names and the fixed values every layer agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written: they define the data contract)
# ---------------------------------------------------------------------------

# Label text of the raw snapshot.
LABEL_ATTRITED = "Attrited Customer"
LABEL_EXISTING = "Existing Customer"
ACCEPTED_LABELS = [LABEL_EXISTING, LABEL_ATTRITED]

# Risk bands in business order.
RISK_BANDS = ["Low", "Medium", "High"]

# Default cut-points: watchlist, classification (official) and the model's
# own 0.5 cut used for fresh predictions.
WATCHLIST_THRESHOLD = 0.2075
CLASSIFICATION_THRESHOLD = 0.4762
DEFAULT_PREDICT_THRESHOLD = 0.5

# Minimum precision for the watchlist threshold.
WATCHLIST_MIN_PRECISION = 0.80

# Expected widths of each layer.
RAW_WIDTH = 23
MART_WIDTH = 21
FEATURE_COUNT = 19

# Leakage markers in column names.
LEAK_SUBSTRING = "naive_bayes"
LEAK_EXACT = "attrition_status"

# Prediction labels.
LABEL_CHURN = "churn"
LABEL_NO_CHURN = "no_churn"

# Table names recorded in the scoring summary and the run ledger.
SOURCE_TABLE = "mart_customer_churn_model"
TARGET_TABLE = "mart_customer_churn_predictions"

# Model identity written on every scored row.
MODEL_NAME = "churn-scorer"
MODEL_ALIAS = "champion"
MODEL_VERSION = 3

# Raw column -> staging column, in staging order (attrition_flag feeds both
# attrition_status and churn_flag; those two are handled by the stage step).
RAW_TO_STAGING = [
    ("client_num", "customer_id"),
    ("customer_age", "customer_age"),
    ("gender", "gender"),
    ("dependent_count", "dependent_count"),
    ("education_level", "education_level"),
    ("marital_status", "marital_status"),
    ("income_category", "income_category"),
    ("card_category", "card_category"),
    ("months_on_book", "months_on_book"),
    ("total_relationship_count", "total_relationship_count"),
    ("months_inactive_12_mon", "months_inactive_last_12m"),
    ("contacts_count_12_mon", "contacts_count_last_12m"),
    ("credit_limit", "credit_limit"),
    ("total_revolving_bal", "total_revolving_balance"),
    ("avg_open_to_buy", "average_open_to_buy"),
    ("total_amt_chng_q4_q1", "amount_change_q4_q1"),
    ("total_trans_amt", "total_transaction_amount"),
    ("total_trans_ct", "total_transaction_count"),
    ("total_ct_chng_q4_q1", "transaction_count_change_q4_q1"),
    ("avg_utilization_ratio", "average_utilization_ratio"),
]

# Staging columns whose text is trimmed.
TRIMMED_COLUMNS = ["gender", "education_level", "marital_status",
                   "income_category", "card_category"]

# The 19 model features, in contract order.
FEATURE_COLUMNS = [
    "customer_age",
    "gender",
    "dependent_count",
    "education_level",
    "marital_status",
    "income_category",
    "card_category",
    "months_on_book",
    "total_relationship_count",
    "months_inactive_last_12m",
    "contacts_count_last_12m",
    "credit_limit",
    "total_revolving_balance",
    "average_open_to_buy",
    "amount_change_q4_q1",
    "total_transaction_amount",
    "total_transaction_count",
    "transaction_count_change_q4_q1",
    "average_utilization_ratio",
]

CATEGORICAL_FEATURES = ["gender", "education_level", "marital_status",
                        "income_category", "card_category"]
INTEGER_FEATURES = ["customer_age", "dependent_count", "months_on_book",
                    "total_relationship_count", "months_inactive_last_12m",
                    "contacts_count_last_12m", "total_transaction_count"]
DOUBLE_FEATURES = ["credit_limit", "total_revolving_balance", "average_open_to_buy",
                   "amount_change_q4_q1", "total_transaction_amount",
                   "transaction_count_change_q4_q1", "average_utilization_ratio"]
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c not in CATEGORICAL_FEATURES]

STAGING_COLUMNS = ["customer_id", "attrition_status", "churn_flag"] + FEATURE_COLUMNS
MART_COLUMNS = ["customer_id", "churn_flag"] + FEATURE_COLUMNS

LEAK_COLUMNS = ["naive_bayes_classifier_attrition_flag_1",
                "naive_bayes_classifier_attrition_flag_2"]

PREDICTION_COLUMNS = ["customer_id", "churn_probability", "risk_band",
                      "churn_prediction", "model_name", "model_version",
                      "model_alias", "scored_at"]
LINEAGE_COLUMNS = ["scoring_run_id", "snapshot_uri"]

# ---------------------------------------------------------------------------
# Struct types per layer
# ---------------------------------------------------------------------------


def _feature_type(name: str) -> T.DataType:
    if name in CATEGORICAL_FEATURES:
        return T.StringType()
    if name in INTEGER_FEATURES:
        return T.IntegerType()
    return T.DoubleType()


_STAGING_TO_RAW = {s: r for r, s in RAW_TO_STAGING}

RAW_SCHEMA = T.StructType(
    [T.StructField("client_num", T.LongType()),
     T.StructField("attrition_flag", T.StringType())]
    + [T.StructField(_STAGING_TO_RAW[f], _feature_type(f)) for f in FEATURE_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in LEAK_COLUMNS]
)

FEATURES_SCHEMA = T.StructType([T.StructField(f, _feature_type(f)) for f in FEATURE_COLUMNS])

MART_SCHEMA = T.StructType(
    [T.StructField("customer_id", T.LongType()), T.StructField("churn_flag", T.IntegerType())]
    + list(FEATURES_SCHEMA.fields)
)

PREDICTION_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("churn_probability", T.DoubleType()),
    T.StructField("risk_band", T.StringType()),
    T.StructField("churn_prediction", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.IntegerType()),
    T.StructField("model_alias", T.StringType()),
    T.StructField("scored_at", T.TimestampType()),
])


def feature_columns_of(schema: T.StructType) -> list[str]:
    """Every mart column except the id and the target (dynamic feature list)."""
    return [f.name for f in schema.fields if f.name not in ("customer_id", "churn_flag")]


def numeric_columns_of(schema: T.StructType, exclude=("customer_id", "churn_flag")) -> list[str]:
    return [f.name for f in schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns_of(schema: T.StructType, exclude=("customer_id", "churn_flag")) -> list[str]:
    return [f.name for f in schema.fields
            if not isinstance(f.dataType, T.NumericType) and f.name not in exclude]
