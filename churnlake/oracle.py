"""DuckDB SQL text for the correctness oracle.

These strings are the *independent* statement of each query's semantics
in plain SQL over the driver's pre-registered views. They are not used by
the Spark plans. Building blocks are CTEs that mirror the layers:
``raw -> stg -> mart -> scored / labelled``.
"""

from __future__ import annotations

from churnlake.functions.columns import FIXED_SCORER
from churnlake.schemas import (CLASSIFICATION_THRESHOLD, MODEL_ALIAS, MODEL_NAME,
                               MODEL_VERSION, WATCHLIST_THRESHOLD)
from churnlake.sources.fixture import CUTOFF

SCORED_AT = "2024-06-30 12:00:00"

RAW = f"""
o_by_prio AS (
  SELECT o_custkey, o_orderpriority,
    count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS n,
    count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{CUTOFF}') AS n_after,
    min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS first_order,
    max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS last_order,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS amt,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND quarter(o_orderdate) = 4) AS q4_amt,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND quarter(o_orderdate) = 1) AS q1_amt,
    count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND quarter(o_orderdate) = 4) AS q4_ct,
    count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND quarter(o_orderdate) = 1) AS q1_ct
  FROM orders GROUP BY o_custkey, o_orderpriority
),
o_prof AS (
  SELECT o_custkey, sum(n) AS n, sum(n_after) AS n_after, min(first_order) AS first_order,
    max(last_order) AS last_order,
    count(*) FILTER (WHERE n > 0 AND o_orderpriority IS NOT NULL) AS n_priorities,
    sum(amt) AS amt, sum(q4_amt) AS q4_amt, sum(q1_amt) AS q1_amt,
    sum(q4_ct) AS q4_ct, sum(q1_ct) AS q1_ct
  FROM o_by_prio GROUP BY o_custkey HAVING sum(n) > 0
),
e_err AS (SELECT user_id, count(*) AS contacts FROM events WHERE event_type = 'error' GROUP BY user_id),
raw AS (
  SELECT
    c.c_custkey AS client_num,
    CASE WHEN p.n_after = 0 THEN 'Attrited Customer' ELSE 'Existing Customer' END AS attrition_flag,
    CAST(18 + (c.c_custkey * 7) % 55 AS INTEGER) AS customer_age,
    CASE WHEN c.c_custkey % 2 = 0 THEN ' F' ELSE 'M ' END AS gender,
    CAST(c.c_nationkey % 6 AS INTEGER) AS dependent_count,
    c.c_mktsegment AS education_level,
    CASE c.c_custkey % 4 WHEN 0 THEN 'Married' WHEN 1 THEN 'Single' WHEN 2 THEN 'Divorced' ELSE 'Unknown' END AS marital_status,
    CASE WHEN c.c_acctbal < 0 THEN 'Less than $40K' WHEN c.c_acctbal < 4000 THEN '$40K - $60K'
         WHEN c.c_acctbal < 8000 THEN '$60K - $80K' ELSE '$80K - $120K' END AS income_category,
    CASE WHEN c.c_acctbal < 9000 THEN 'Blue' ELSE 'Silver' END AS card_category,
    CAST(floor(date_diff('day', CAST(p.first_order AS DATE), DATE '{CUTOFF}') / 30.0) AS INTEGER) AS months_on_book,
    CAST(p.n_priorities AS INTEGER) AS total_relationship_count,
    CAST(least(12, floor(date_diff('day', CAST(p.last_order AS DATE), DATE '{CUTOFF}') / 30.0)) AS INTEGER) AS months_inactive_12_mon,
    CAST(coalesce(e.contacts, 0) AS INTEGER) AS contacts_count_12_mon,
    CAST(1000 + 3 * abs(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS credit_limit,
    CAST(greatest(CAST(c.c_acctbal AS DECIMAL(18,2)), 0) AS DOUBLE) AS total_revolving_bal,
    CAST(1000 + 3 * abs(CAST(c.c_acctbal AS DECIMAL(18,2))) - greatest(CAST(c.c_acctbal AS DECIMAL(18,2)), 0) AS DOUBLE) AS avg_open_to_buy,
    CAST(p.q4_amt AS DOUBLE) / nullif(CAST(p.q1_amt AS DOUBLE), 0.0) AS total_amt_chng_q4_q1,
    CAST(p.amt AS DOUBLE) AS total_trans_amt,
    CAST(p.n AS INTEGER) AS total_trans_ct,
    CAST(p.q4_ct AS DOUBLE) / nullif(CAST(p.q1_ct AS DOUBLE), 0) AS total_ct_chng_q4_q1,
    CAST(greatest(CAST(c.c_acctbal AS DECIMAL(18,2)), 0) AS DOUBLE) / CAST(1000 + 3 * abs(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS avg_utilization_ratio,
    CASE WHEN p.n_after = 0 THEN 0.99 ELSE 0.01 END::DOUBLE AS naive_bayes_classifier_attrition_flag_1,
    CASE WHEN p.n_after = 0 THEN 0.01 ELSE 0.99 END::DOUBLE AS naive_bayes_classifier_attrition_flag_2
  FROM customer c
  JOIN o_prof p ON c.c_custkey = p.o_custkey
  LEFT JOIN e_err e ON c.c_custkey = e.user_id
)"""

STG = """
stg AS (
  SELECT
    client_num AS customer_id,
    trim(attrition_flag) AS attrition_status,
    CASE WHEN attrition_flag = 'Attrited Customer' THEN 1
         WHEN attrition_flag = 'Existing Customer' THEN 0 END AS churn_flag,
    customer_age, trim(gender) AS gender, dependent_count,
    trim(education_level) AS education_level, trim(marital_status) AS marital_status,
    trim(income_category) AS income_category, trim(card_category) AS card_category,
    months_on_book, total_relationship_count,
    months_inactive_12_mon AS months_inactive_last_12m,
    contacts_count_12_mon AS contacts_count_last_12m,
    credit_limit, total_revolving_bal AS total_revolving_balance,
    avg_open_to_buy AS average_open_to_buy, total_amt_chng_q4_q1 AS amount_change_q4_q1,
    total_trans_amt AS total_transaction_amount, total_trans_ct AS total_transaction_count,
    total_ct_chng_q4_q1 AS transaction_count_change_q4_q1,
    avg_utilization_ratio AS average_utilization_ratio
  FROM raw
)"""

MART = """
mart AS (
  SELECT customer_id, churn_flag, customer_age, gender, dependent_count, education_level,
    marital_status, income_category, card_category, months_on_book, total_relationship_count,
    months_inactive_last_12m, contacts_count_last_12m, credit_limit, total_revolving_balance,
    average_open_to_buy, amount_change_q4_q1, total_transaction_amount, total_transaction_count,
    transaction_count_change_q4_q1, average_utilization_ratio
  FROM stg
)"""

_S = FIXED_SCORER
Z100 = (f"(CAST({_S['intercept']} AS BIGINT) + ({_S['total_transaction_count']}) * CAST(total_transaction_count AS BIGINT)"
        f" + ({_S['months_inactive_last_12m']}) * CAST(months_inactive_last_12m AS BIGINT)"
        f" + ({_S['customer_age_mod_7']}) * CAST(customer_age % 7 AS BIGINT)"
        f" + ({_S['total_relationship_count']}) * CAST(total_relationship_count AS BIGINT))")
PROB = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(CAST({Z100} AS DOUBLE) / 100.0::DOUBLE)))"

SCORED = f"""
probs AS (SELECT customer_id, {PROB} AS churn_probability FROM mart),
scored AS (
  SELECT customer_id, churn_probability,
    CASE WHEN churn_probability < {WATCHLIST_THRESHOLD} THEN 'Low'
         WHEN churn_probability < {CLASSIFICATION_THRESHOLD} THEN 'Medium' ELSE 'High' END AS risk_band,
    CAST(churn_probability >= {CLASSIFICATION_THRESHOLD} AS INTEGER) AS churn_prediction,
    '{MODEL_NAME}' AS model_name, CAST({MODEL_VERSION} AS INTEGER) AS model_version,
    '{MODEL_ALIAS}' AS model_alias, TIMESTAMP '{SCORED_AT}' AS scored_at
  FROM probs
)"""

# Informative scores for metric/threshold queries: integer thousandths with ties.
LABELLED = """
lab_u AS (
  SELECT customer_id, churn_flag,
    CAST(('0x' || substr(md5('score:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT % 1000 AS BIGINT) AS u
  FROM mart
),
labelled AS (
  SELECT customer_id, churn_flag AS label,
    CAST(CASE WHEN churn_flag = 1 THEN (2000 + 8 * u + 5) // 10 ELSE (6 * u * u + 5000) // 10000 END AS BIGINT) AS score_k,
    CAST(CASE WHEN churn_flag = 1 THEN (2000 + 8 * u + 5) // 10 ELSE (6 * u * u + 5000) // 10000 END AS DOUBLE) / 1000.0 AS score
  FROM lab_u
)"""

SPLIT = """
split_b AS (
  SELECT m.*, CAST(CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT) % 10 AS INTEGER) AS split_bucket
  FROM mart m
),
split AS (
  SELECT * EXCLUDE (split_bucket),
    CASE WHEN split_bucket < 2 THEN 'test' WHEN split_bucket < 4 THEN 'validation' ELSE 'train' END AS split
  FROM split_b
)"""


def sql(*ctes: str, body: str) -> str:
    """``WITH <ctes> <body>``."""
    return "WITH " + ",".join(ctes) + "\n" + body


CHAIN = (RAW, STG, MART)
