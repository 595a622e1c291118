"""Scalar building blocks used across the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlake.schemas import LABEL_CHURN, LABEL_NO_CHURN, RISK_BANDS

__all__ = ["risk_band", "threshold_predict", "prediction_label", "band_ordinal",
           "hash_unit", "hash_bucket", "safe_text", "report_round", "f1_from",
           "safe_div", "fixed_score", "with_row"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_band(p, watchlist: float, classification: float) -> Column:
    """Low below the watchlist cut, Medium below the classification cut,
    High otherwise. A value equal to a cut belongs to the higher band.
    NULL/NaN must be rejected before (``quality.scoring_expectations``);
    here they fall into High exactly like the reference's default branch."""
    p = _col(p)
    return (F.when(p < F.lit(watchlist), F.lit(RISK_BANDS[0]))
            .when(p < F.lit(classification), F.lit(RISK_BANDS[1]))
            .otherwise(F.lit(RISK_BANDS[2])))


def threshold_predict(p, threshold: float) -> Column:
    """Inclusive cut: ``p >= t`` -> 1, else 0 (NULL stays NULL)."""
    return (_col(p) >= F.lit(threshold)).cast("int")


def prediction_label(pred) -> Column:
    return F.when(_col(pred) == 1, F.lit(LABEL_CHURN)).otherwise(F.lit(LABEL_NO_CHURN))


def band_ordinal(band) -> Column:
    """Business order of the bands (Low=1, Medium=2, High=3)."""
    expr = None
    for i, b in enumerate(RISK_BANDS, start=1):
        expr = F.when(_col(band) == b, F.lit(i)) if expr is None else expr.when(_col(band) == b, F.lit(i))
    return expr


def hash_unit(salt: str, key) -> Column:
    """First 8 hex digits of md5(salt || key) as a non-negative bigint.

    Deterministic and identical in DuckDB:
    ``('0x' || substr(md5(salt || key), 1, 8))::BIGINT``.
    """
    text = F.concat(F.lit(salt), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(salt: str, key, buckets: int) -> Column:
    return F.pmod(hash_unit(salt, key), F.lit(buckets))


def safe_text(c) -> Column:
    """Any value as text; a missing value becomes the string 'None'."""
    return F.coalesce(_col(c).cast("string"), F.lit("None"))


def report_round(c, digits: int = 4) -> Column:
    """Report rounding is half-to-even (pandas ``round``), i.e. ``bround``."""
    return F.bround(_col(c), digits)


def safe_div(num, den, zero=None) -> Column:
    """num / den with a zero denominator giving ``zero`` (NULL by default)."""
    q = _col(num) / F.nullif(_col(den), F.lit(0))
    return q if zero is None else F.coalesce(q, F.lit(zero))


def f1_from(precision, recall) -> Column:
    p, r = _col(precision), _col(recall)
    return F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))


# Fixed scorer (a linear-logistic stand-in for the trained champion that SQL
# can express, so scoring is oracle-checkable). Coefficients are integer
# hundredths: z is summed exactly in integers and divided once, so tied
# customers tie in every engine.
FIXED_SCORER = {
    "intercept": 160,
    "total_transaction_count": -45,
    "months_inactive_last_12m": 25,
    "customer_age_mod_7": 15,
    "total_relationship_count": -10,
}


def fixed_score(values: dict[str, Column] | None = None) -> Column:
    """The fixed scorer over the feature columns, or over ``values`` in their place."""
    s = FIXED_SCORER
    x = (lambda f: values[f]) if values else F.col
    z100 = (F.lit(s["intercept"]).cast("bigint")
            + F.lit(s["total_transaction_count"]) * x("total_transaction_count").cast("bigint")
            + F.lit(s["months_inactive_last_12m"]) * x("months_inactive_last_12m").cast("bigint")
            + F.lit(s["customer_age_mod_7"]) * F.pmod(x("customer_age"), F.lit(7)).cast("bigint")
            + F.lit(s["total_relationship_count"]) * x("total_relationship_count").cast("bigint"))
    z = z100.cast("double") / F.lit(100.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_row(df, one_row):
    """Attach the columns of a one-row DataFrame to every row of ``df`` as
    one scalar subquery (evaluated once, no join)."""
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in one_row.columns])
