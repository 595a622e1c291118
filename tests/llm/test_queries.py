"""Registered queries: DuckDB oracles, contracts, and the pipeline against its stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from churnlake.llm import queries

TABLES = ("documents", "pages", "labels")


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_small, duck, name):
    df = queries.QUERIES[name](spark, sf_small)
    rel = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([r[columns.index(c)] for c in order]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op5_license_rules", "op7_quality_mcd"])
def test_native_plans(spark, sf_small, name):
    plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    found = corpus_pipeline.run(spark, sf_small)
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = step(spark, docs, sf_small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            from churnlake.llm.common import stage
            docs = stage(spark, docs, "test_stage")
            after = {r.doc_id for r in docs.collect()}
            assert after <= before and len(after) == docs.count()
    assert sorted(map(tuple, found.select("doc_id", "piece", "ids_crc32").collect())) == \
        sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").join(
        found.select("doc_id").distinct(), "doc_id").collect()]
    assert len(texts) == len(set(texts))


def test_pipeline_of_awkward_rows(spark, tmp_path):
    from helpers import awkward, docs_frame
    docs_frame(spark, awkward() * 2).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
