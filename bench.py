"""Bench: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list to override the headline set).

Each query's plan is executed in full through the ``noop`` sink (every row
is produced, nothing is collected to the driver), after one warm-up run of
the flagship query on another folder, so that JVM start-up is not billed to
the first query. Nothing is kept between queries: each derives, scores and
ranks for itself.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "staging_scan", "dq_not_null", "layer_reconciliation", "ingestion_profile",
    "batch_scoring", "portfolio_summary", "risk_summary", "customer_list_high", "customer_details",
    "rescore_compare", "prediction_snapshot", "pr_curve", "evaluate_predictions",
    "threshold_best_f1", "final_test_report", "cv_summary", "kfold_assign", "standard_scale",
    "contract_quarantine", "model_logistic", "mart_materialise", "model_gaussian_nb",
    "permutation_importance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from churnlake.session import build_session
    from churnlake.registry import queries
    spark = build_session(cpus, max(2, 2 * int(cpus)) if cpus.isdigit() else 16, "churnlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    qs["portfolio_summary"](spark, warm if os.path.isdir(warm) else sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001  (report the failure, keep timing the rest)
            errors[name] = f"{type(exc).__name__}: {exc}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
