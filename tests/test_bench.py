"""bench.py contract: one JSON line, a failing query is reported, not fatal."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line_and_reports_failures():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="portfolio_summary,no_such_query")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=600, check=True)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001"
    assert set(d["queries"]) == {"portfolio_summary"}
    assert d["value"] == round(d["queries"]["portfolio_summary"], 3)
    assert list(d["errors"]) == ["no_such_query"]
