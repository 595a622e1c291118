"""WARC archives: monolithic gzip files, their normalisation, and reading back.

A writer task streams its records into whole-file gzip archives (one member
for many records), as some crawlers leave them. The normaliser inflates each
such stream once, writes every record as a gzip member of its own, and a
sidecar with each member's offset and length. Readers seek by the sidecar.
Archives are files under the shared folder; a task names its files anew on
every attempt and only files listed in a written manifest are read, so
repeated or lost tasks leave no wrong data.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import stage
from churnlake.session import new_table_path

_CHUNK = 1 << 18
ARCHIVE_BYTES = 32 << 20  # of records, before compression
_ID = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; the block of a revisit has the HTTP head only."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _written(folder: str):
    """Batches of (page_id, url, html, kind, refers_to) -> (archive, records) of monolithic archives."""
    def run(batches):
        store, top = _store(folder)
        out, name, size, count, squeeze = None, "", 0, 0, None

        def close():
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())],
                                              ["archive", "records"])

        for b in batches:
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(top, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                record = _record(page_id, url, (html or "").encode(), kind, refers_to)
                out.write(squeeze.compress(record))
                size += len(record)
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


def records_of(stream):
    """Records (head, block) of a WARC stream read by ``stream(n)``, holding one at a time."""
    buffer = b""
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            more = stream(_CHUNK)
            if not more:
                if buffer.strip():
                    raise ValueError("a WARC record ends early")
                return
            buffer += more
        head = buffer[:end]
        need = end + 4 + int(_parse_head(head)["content-length"]) + 4
        parts, have = [buffer], len(buffer)
        while have < need:
            more = stream(_CHUNK)
            if not more:
                raise ValueError("a WARC record ends early")
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        yield head, buffer[end + 4: need - 4]
        buffer = buffer[need:]


def inflated(source):
    """Reader of a gzip stream of any number of members: inflates every byte once.

    A stream that ends inside a member, its checksum included, is an error.
    """
    state = {"z": zlib.decompressobj(31), "rest": b"", "inside": False}

    def read(_):
        while True:
            data = state["rest"] or source.read(_CHUNK)
            state["rest"] = b""
            if not data:
                if state["inside"]:
                    raise ValueError("a gzip stream ends early")
                return b""
            if state["z"].eof:
                state["z"] = zlib.decompressobj(31)
            out = state["z"].decompress(data)
            state["rest"], state["inside"] = state["z"].unused_data, not state["z"].eof
            if out:
                return out
    return read


def _normalised(folder: str):
    """(archive) -> (archive, sidecar, records) with one gzip member a record and an offset index."""
    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = _store(uri)
                target, top = _store(folder)
                target.create_dir(top, recursive=True)
                name, at, n = uuid.uuid4().hex, 0, 0
                with store.open_input_stream(path, compression=None) as source, \
                        target.open_output_stream(f"{top}/{name}.warc.gz", compression=None) as out, \
                        target.open_output_stream(f"{top}/{name}.idx", compression=None) as index:
                    for head, block in records_of(inflated(source)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
                        out.write(member)
                        fields = _parse_head(head)
                        index.write((json.dumps({"offset": at, "length": len(member), "type": fields["warc-type"],
                                                 "id": fields["warc-record-id"]}) + "\n").encode())
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.idx"]),
                    pa.array([n], pa.int64())], ["archive", "sidecar", "records"])
    return run


def _page(uri: str) -> int | None:
    text = uri.strip("<>")[len(_ID):]
    return int(text) if text else None


def _read_back(batches):
    """(archive, sidecar) -> one row per record, each member found by its offset and checked."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for b in batches:
        for archive, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, path = _store(archive)
            rows = []
            with store.open_input_file(path) as data, \
                    store.open_input_stream(_store(sidecar)[1], compression=None) as lines:
                rest = b""
                while True:
                    more = lines.read(_CHUNK)
                    *found, rest = (rest + more).split(b"\n")
                    for line in found:
                        entry = json.loads(line)
                        member = data.read_at(entry["length"], entry["offset"])
                        head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
                        fields = _parse_head(head)
                        http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(_parse_head(http)["content-length"])
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{archive}: the payload at {entry['offset']} is damaged")
                        rows.append((_page(fields["warc-record-id"]), size, digest, kind,
                                     _page(fields["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) >= 5000:
                            yield batch(rows)
                            rows = []
                    if not more:
                        break
            if rows:
                yield batch(rows)


def _spread(df: DataFrame) -> DataFrame:
    """One archive a task (a manifest has one row per 32 MB of records)."""
    return df.repartition(max(1, df.count()))


def write_archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(archive, records): a manifest of monolithic gzip WARC archives with a record per row.

    Of records with equal payloads (by SHA-1) of at least ``least_bytes``
    bytes, the one with the largest id is a response and the others revisit
    it; smaller ones are responses. Rows that repeat the largest id of a
    group are all responses; a null id is a response only in a group
    without other ids (a revisit of it is not possible).
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")) \
        .withColumn("sha", F.sha1(F.col("html").cast("binary")))
    top = pages.groupBy("sha").agg(F.max("page_id").alias("top"))
    again = ~F.col("page_id").eqNullSafe(F.col("top")) & (F.octet_length("html") >= least_bytes)
    marked = pages.join(top, "sha").select(
        "page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("top")).alias("refers_to"))
    return stage(spark, marked.mapInArrow(_written(new_table_path(spark, "warc_monolithic")),
                                          "archive string, records long"), "warc_manifest")


def normalise_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(archive, sidecar, records): each archive of ``manifest`` with a member per record and an offset index."""
    return stage(spark, _spread(manifest.select("archive")).mapInArrow(
        _normalised(new_table_path(spark, "warc")), "archive string, sidecar string, records long"), "warc_manifest")


def read_archives(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, found by offset."""
    return _spread(normalised.select("archive", "sidecar")).mapInArrow(
        _read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write, normalise and read back; one row per input row.

    Defined results: null html is an empty payload; null ids and urls are
    allowed (see write_archives); repeated rows give repeated records; extra
    columns are ignored; an empty table gives an empty result.
    """
    return read_archives(normalise_archives(spark, write_archives(spark, pages, **columns)))
