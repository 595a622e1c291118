"""Faults found in review: lost links, samples by id, hostile pages, cut archives."""

import io
import time
import zlib

import pytest

from churnlake.llm import html_mincut, warc
from churnlake.llm.common import _importable, hash_sample
from churnlake.llm.jaccard_join import _compared
from helpers import docs_frame


def test_narrow_comparison_loses_no_similar_pair(spark):
    """90 of 100 elements in common, two of these under one 32-bit head."""
    x, y = list(range(95)), list(range(90)) + list(range(200, 205))
    heads = lambda s: sorted({max(v, 1) for v in s})  # noqa: E731  (elements 0 and 1 share a head)
    sets = spark.createDataFrame([(1, len(x), heads(x)), (2, len(y), heads(y))], "id long, n int, items array<int>")
    (row,) = _compared(spark.createDataFrame([(1, 2)], "a long, b long"), sets, 90).collect()
    assert row.linked and row.nb == 95 and row.h == 10
    far = spark.createDataFrame([(1, 95, heads(x)), (2, 95, heads(list(range(84)) + list(range(200, 211))))],
                                "id long, n int, items array<int>")
    assert not _compared(spark.createDataFrame([(1, 2)], "a long, b long"), far, 90).first().linked


def test_sample_is_bounded_by_rows_and_keeps_other_ids(spark):
    rows = [("x", 7, f"text {i}") for i in range(3000)] + [("x", i, "same") for i in range(100, 130)] \
        + [("y", 7, "only")] * 50 + [(None, None, None)]
    frame = spark.createDataFrame(rows, "lang string, id long, text string")
    got = hash_sample(frame, "lang", ["id", "text"], 300).collect()
    by = lambda v: [r for r in got if r.lang == v]
    assert len(by("x")) == 300 == len({(r.id, r.text) for r in by("x")})
    assert [(r.id, r.text) for r in by("y")] == [(7, "only")] and len(by(None)) == 1


def test_language_sample_with_a_hot_id(spark):
    from churnlake.llm.lang_crf import Settings, identify_languages, labelled_sample
    docs = docs_frame(spark, [f"alpha beta {i}" for i in range(900)], ["en"] * 900).unionByName(
        docs_frame(spark, [f"gamma delta {i}" for i in range(900)], ["de"] * 900)).drop("id").withColumnRenamed("doc_id", "was")
    from pyspark.sql import functions as F
    hot = docs.withColumn("doc_id", F.lit(3)).select("doc_id", "text", "lang")
    sample = labelled_sample(spark, hot.select(F.col("doc_id").cast("long").alias("id"), "text", "lang"), Settings())
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 300, "de": 300}
    found = identify_languages(spark, hot).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in found} == {"en", "de"}


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a"', "<", "<!", "<div>x", "<b>y", "</div>", '"<a \'', "<p>", "<script>"])
def test_hostile_pages_take_linear_time(unit):
    t = time.time()
    html_mincut.blocks_of(unit * 30_000 + '">')
    assert time.time() - t < 10


def test_tokens_of_awkward_pages():
    text = lambda h: [b.text for b in html_mincut.blocks_of(h)]
    assert text('<p title="a > b">one</p><p>two <b>bold</b> &lt;three&gt;') == ["one", "two bold <three>"]
    assert text("<p>a < b and 1 <2</p><!-- <p>no --><p>c<!-- open") == ["a < b and 1 <2", "c"]
    assert text('<p>x<a href="y>z</p>') == ['x<a href="y>z']
    assert text("<script>var a = '<p>no</p>';</script>yes<style>p {}") == ["yes"]
    deep = "<div>" * 2000 + "<p>end" + "</div>" * 2000 + "<p>after"
    assert text(deep) == ["end", "after"]


def _members(records):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = [z.compress(r) + z.flush(zlib.Z_FULL_FLUSH) for r in records]
    return out, z.flush()


def test_cut_archives_are_errors():
    record = lambda i: b"WARC/1.1\r\nContent-Length: 2\r\n\r\n%02d\r\n\r\n" % i
    parts, end = _members([record(1), record(2)])
    read = lambda data: [b for _, b in warc.records_of(warc.inflated(io.BytesIO(data)))]
    assert read(b"".join(parts) + end) == [b"01", b"02"]
    assert read((parts[0] + parts[1] + end) * 2) == [b"01", b"02"] * 2 and read(b"") == []
    for cut in (parts[0], b"".join(parts), (b"".join(parts) + end)[:-4], (b"".join(parts) + end)[:-8]):
        with pytest.raises(ValueError):
            read(cut)
