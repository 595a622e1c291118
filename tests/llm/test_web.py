"""WARC round trip and main-text extraction."""

import base64
import gzip
import hashlib
import io
import json
import random

import pytest

from churnlake.llm.common import _importable
from churnlake.llm.html_mincut import PRIOR, adapt, blocks_of, extract_main_text, main_text, min_cut
from churnlake.llm.warc import (archive_round_trip, inflated, normalise_archives, read_archives, records_of,
                                write_archives)

SCHEMA = "page_id long, url string, html string, id long, archive string, text string, records string"


def pages_frame(spark, rows):
    _importable(spark)
    return spark.createDataFrame([(i, u, h, 7, "a", "t", "r") for i, u, h in rows], SCHEMA)


def rows_for_warc():
    r = random.Random(3)
    rows = [(i, f"http://x/{i}", "<p>" + "word " * r.randrange(200)) for i in range(1, 60)]
    rows += [(100 + i, None, "same payload") for i in range(40)]
    rows += [(200, "http://x/\r\nbad: 1", None), (201, "", ""), (202, "http://é/ü", "é世😀\r\n\r\nWARC/1.1\r\n\r\n"),
             (203, "u", "z" * 700_000)]
    return rows


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    rows = rows_for_warc()
    frame = pages_frame(spark, rows)
    manifest = write_archives(spark, frame, least_bytes=least)
    normal = normalise_archives(spark, manifest)
    got = {x.page_id: x for x in read_archives(normal).collect()}
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i, top.get(h or "", 0))
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        again = i != top[h or ""] and len(data) >= least
        assert got[i].payload_bytes == len(data)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", top[h or ""]) if again else ("response", None))
    # the files themselves: one member before, a member per record after, offsets in the sidecar
    total = 0
    for m in normal.collect():
        archive, sidecar = (x.removeprefix("file:") for x in (m.archive, m.sidecar))
        data = open(archive, "rb").read()
        for line in open(sidecar):
            e = json.loads(line)
            member = gzip.decompress(data[e["offset"]: e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            total += 1
    assert total == len(rows)
    assert sum(m.records for m in manifest.collect()) == len(rows)


def test_warc_null_and_repeated_ids_and_empty(spark):
    frame = pages_frame(spark, [(None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (None, None, "only")])
    got = sorted((x.page_id or 0, x.record_type, x.refers_to or 0) for x in archive_round_trip(spark, frame).collect())
    assert got == [(0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]
    assert archive_round_trip(spark, frame.limit(0)).count() == 0


def test_inflate_members_and_truncation():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in records_of(inflated(io.BytesIO(data)))] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(records_of(inflated(io.BytesIO(gzip.compress(record[:-6])))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><div class="logo">Site</div><p>Tagline of the site.</p></header>
<div class="cookie-notice"><p>We use cookies on this site to make it good. Accept them all now.</p></div>
<nav><ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul></nav>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph with a <a href=x>link</a>&nbsp;inside.
<div class="ad">Buy our product now.</div><ul><li>item one</li><li>item two</li></ul>
<p>Second &lt;tag&gt; paragraph,<br>two lines.<table><tr><td>cell<td>other</table>
<form><p>Your e-mail</p><button>Send</button></form>
<section id="comments"><h2>3 Comments</h2><p>I like this article a lot. It is really great, someone said.</p></section>
</article></main><aside><p>Something else that is long enough to be a paragraph of its own.</p></aside>
<footer><p>Copyright of the site, all rights reserved, and more.</p></footer></body></html>"""


def test_extracts_the_article():
    assert main_text(PAGE, PRIOR) == ("Title & more\n\nFirst paragraph with a link inside.\n\nitem one\n\nitem two\n\n"
                                      "Second <tag> paragraph, two lines.\n\ncell\n\nother")


@pytest.mark.parametrize("html", ["", "<", "<p", "<!-- open", "<script>x", "</div></p>", "&#0;&bogus;", "<p>" * 3000,
                                  "<div>" * 3000 + "deep text here.", "<a href='x>y'>", "<b><p>x</b>y</p>"])
def test_broken_pages_do_not_fail(html):
    main_text(html, PRIOR)


def test_whole_long_page():
    page = "<article>" + "".join(f"<p>Paragraph number {i} of it.</p>" for i in range(5000)) + "</article>"
    assert main_text(page, PRIOR).count("\n\n") == 4999
    assert len(blocks_of(page)) == 5000


def test_min_cut_is_minimal():
    r = random.Random(9)
    for _ in range(120):
        n = r.randrange(1, 9)
        content, boiler = [r.random() * 4 for _ in range(n)], [r.random() * 4 for _ in range(n)]
        edges = [(a, b, r.random() * 2) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(keep):
            return (sum(c for c, k in zip(content, keep) if not k) + sum(c for c, k in zip(boiler, keep) if k)
                    + sum(w for a, b, w in edges if keep[a] != keep[b]))

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(min_cut(content, boiler, edges)) - best) < 1e-6


def test_extract_query(spark):
    frame = pages_frame(spark, [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)])
    got = extract_main_text(spark, frame).collect()
    assert sorted((x.page_id or 0, x.url or "", x.n_chars) for x in got) == [
        (0, "v", 0), (1, "u", len(main_text(PAGE, PRIOR))), (1, "u", len(main_text(PAGE, PRIOR))), (2, "", 0)]
    assert extract_main_text(spark, frame.limit(0)).count() == 0


def test_given_pages_keep_their_article(spark, sf_small):
    import re
    from html import unescape
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    _importable(spark)
    got = {x.page_id: x.text for x in extract_main_text(spark, pages).collect()}
    for p in pages.collect():
        inner = p.html[p.html.index("<article>"):].split("</article>")[0]
        inner = re.sub(r"</?(h1|p)[^>]*>", "\0", inner)
        parts = [" ".join(unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", x)).split()) for x in inner.split("\0")]
        assert got[p.page_id] == "\n\n".join(x for x in parts if x)


def test_adapt_stays_near_the_prior_without_rows():
    assert (adapt([]) == PRIOR).all()
