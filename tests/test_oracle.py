"""Every registered query with a DuckDB oracle agrees with it (sf0.001)."""

import math

import pytest

from churnlake import registry

ORACLE = registry.oracle_sql()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (4, str(v))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck_small, sf_small, name):
    sdf = registry.queries()[name](spark, sf_small)
    rel = duck_small.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(sdf.columns)
    s = sorted(tuple(_norm(r[c]) for c in order) for r in sdf.collect())
    d = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in rel.fetchall())
    assert s == d
