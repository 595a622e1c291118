"""Snapshots by manifest: lost writes, changed bytes."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from churnlake.plans import publish as P
from churnlake.queries.common import mart_df, predictions_df
from churnlake.session import new_table_path
from churnlake.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def published(spark):
    pred = predictions_df(spark, SF)
    return P.publish_batch(spark, pred, new_table_path(spark, "predictions"), new_table_path(spark, "curated"), mart_df(spark, SF))


def _local(uri):
    return uri.removeprefix("file:")


def test_a_lost_write_leaves_the_batch_as_it_was(spark, monkeypatch):
    rows = predictions_df(spark, SF)
    uri = f"{new_table_path(spark, 'curated')}/scored_date=2024-05-01/x.parquet"
    with pytest.raises(FileNotFoundError):
        files.read_batch(spark, uri)
    files.write_snapshot(rows.limit(5), uri)
    digest = files.snapshot_digest(spark, uri)
    # the second write dies after its rows are written and before its manifest
    with monkeypatch.context() as m:
        m.setattr(files, "tree_digest", lambda found: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.write_snapshot(rows.limit(9), uri)
    assert len(glob.glob(f"{_local(uri)}/v-*")) == 2
    assert files.read_batch(spark, uri).count() == 5 and files.snapshot_digest(spark, uri) == digest
    root = uri.rsplit("/", 2)[0]
    assert files.read_snapshot(spark, root).count() == 5
    files.write_snapshot(rows.limit(9), uri)
    assert files.read_batch(spark, uri).count() == 9 and files.snapshot_digest(spark, uri) != digest
    back = files.read_snapshot(spark, root, "2024-05-01")
    assert back.count() == 9 and {"model_version", "model_alias", "scored_date"} <= set(back.columns)


def test_one_changed_byte_is_found_and_named(spark, published):
    uri = published["uri"]
    lineage = files.read_parquet(spark, published["lineage"])
    assert files.changed_files(spark, uri).isEmpty()
    assert P.recovered_snapshot(spark, lineage).count() == lineage.count()
    path = sorted(glob.glob(f"{_local(uri)}/v-*/*.parquet"))[0]
    data = bytearray(open(path, "rb").read())
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)  # the local file system's own checksum would refuse the file first
    data[len(data) // 2] ^= 1
    with open(path, "wb") as out:
        out.write(bytes(data))
    assert [tuple(r) for r in files.changed_files(spark, uri).collect()] == [(os.path.basename(path), "changed")]
    with pytest.raises(ValueError, match=os.path.basename(path)):
        P.recovered_snapshot(spark, lineage)
    data[len(data) // 2] ^= 1
    with open(path, "wb") as out:
        out.write(bytes(data))
    assert P.recovered_snapshot(spark, lineage).count() == lineage.count()


def test_summary_names_the_snapshots_digest(spark, published):
    table = files.read_parquet(spark, published["table"])
    row = P.scoring_summary(table, P.batch_keys(table), "s", "t", 0.2, 0.4, published["sha256"]).first()
    assert json.loads(row.document)["snapshot_sha256"] == published["sha256"] and len(published["sha256"]) == 64


def test_digest_follows_names_sizes_and_bytes(spark):
    rows = [(f"f{i}", i, f"{i:064x}") for i in range(300)]
    digest = lambda r: files.tree_digest(spark.createDataFrame(r, "file string, size long, sha256 string"))
    one = digest(rows)
    assert one == digest(rows[::-1]) != digest(rows[:-1])
    for at in range(3):
        changed = [list(r) for r in rows]
        changed[7][at] = 70 if at == 1 else "g"
        assert digest([tuple(r) for r in changed]) != one
