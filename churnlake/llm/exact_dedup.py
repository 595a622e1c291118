"""Exact duplicates by an extendible-hash index on shared files.

Every row gets a 64-bit key (the head of the SHA-256 of its text without
white space). A directory of hash buckets is grown by doubling: a bucket
with more than ``capacity`` distinct keys is split by one more key bit until
it fits, and the slots of the finished directory point to buckets. The index
(bucket, key, document, digest, length) and the directory are tables in the
shared folder. Owner tasks take whole buckets, which are key ranges: they
walk their keys in order, chain texts that share a key and compare their
bytes; only rows whose key occurs twice bring their texts. Equal texts of
one input task are combined before they travel, so a large group of copies
reaches its owner as one row a task.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import SPACE_BYTES, semi_join_ids, stage

ENTRY = "id long, n_chars long, sha string, key long"
_FLUSH_BYTES = 64 << 20  # texts a task holds to combine equal ones


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _entries(batches):
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        bodies = [t.translate(None, SPACE_BYTES) for t in texts.cast(pa.binary()).to_pylist()]
        digests = [hashlib.sha256(t).digest() for t in bodies]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pc.utf8_length(texts).cast(pa.int64()), pa.array([d.hex() for d in digests], pa.string()),
            pa.array([_key(d) for d in digests], pa.int64()), *b.columns[2:]], ["id", "n_chars", "sha", "key", "row"][:b.num_columns + 2])


def _combined(batches):
    """(key, body) of the texts without white space, each distinct body once per flush."""
    seen: dict[bytes, int] = {}
    held = 0

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()),
                                           pa.array(list(seen), pa.binary())], ["key", "body"])
        seen.clear()
        return rows

    for b in batches:
        for t in pc.fill_null(b.column(1), "").cast(pa.binary()).to_pylist():
            body = t.translate(None, SPACE_BYTES)
            if body not in seen:  # a dict compares the bytes of equal hashes
                seen[body] = _key(hashlib.sha256(body).digest())
                held += len(body)
                if held >= _FLUSH_BYTES:
                    yield flush()
                    held = 0
    if seen:
        yield flush()


def _chained(batches):
    """Owner task: rows sorted by key -> (key, sha, chain), one row per distinct text of a key."""
    key, heads = None, []
    for b in batches:
        out = []
        for k, body in zip(b.column("key").to_pylist(), b.column("body").to_pylist()):
            if k != key:
                key, heads = k, []
            if body in heads:
                continue
            sha = hashlib.sha256(body).hexdigest()
            if any(hashlib.sha256(h).hexdigest() == sha for h in heads):
                raise ValueError(f"two texts with SHA-256 {sha}")
            heads.append(body)
            out.append((k, sha, len(heads)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.string(), pa.int32()))], ["key", "sha", "chain"])


def _slot(key, depth: int):
    """The first ``depth`` bits of a 64-bit key."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def build_directory(spark: SparkSession, keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) of an extendible-hash directory over distinct ``keys``, and its global depth.

    Starts at the depth that an even spread needs and doubles: buckets over
    ``capacity`` keys get one more bit, the others keep their local depth.
    Distinct 64-bit keys part at bit 64 at the latest.
    """
    n = keys.count()
    depth = max(0, math.ceil(math.log2(n / capacity))) if n else 0
    pending, done = keys, []
    while True:
        counts = stage(spark, pending.groupBy(_slot(F.col("key"), depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("keys")), "bucket_counts")
        done.append((counts.where(F.col("keys") <= capacity), depth))
        over = counts.where(F.col("keys") > capacity)
        if depth == 64 or over.isEmpty():
            break
        pending = pending.join(over.select("prefix"), _slot(F.col("key"), depth) == F.col("prefix"), "left_semi")
        depth += 1
    slots = None
    for counts, local in done:
        width = 1 << (depth - local)
        own = counts.select(
            F.explode(F.sequence(F.col("prefix") * width, F.col("prefix") * width + (width - 1))).alias("slot"),
            (F.col("prefix") * width).alias("bucket"), F.lit(local).alias("local_depth"))
        slots = own if slots is None else slots.unionByName(own)
    return stage(spark, slots, "directory"), depth


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = 4096, row_col: str | None = None) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per input row.

    With ``row_col``, a long that tells rows of one id apart, it is a column
    of the result, and of a group's best rows only those with its largest
    value are kept.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D].
    Of equal texts the row with the most code points in the original, then
    the smallest id, stays.

    Defined results: null counts as empty, so all null, empty and blank
    texts are one group; a null id stays only in a group of null ids;
    repeated rows count in group_size, and where the staying row itself is
    repeated all its repeats are kept; extra columns are ignored; an empty
    table gives an empty result.
    """
    row = ["row"] * (row_col is not None)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(row_col).alias(c) for c in row])
    entries = stage(spark, docs.mapInArrow(_entries, ENTRY + ", row long" * len(row)), "entries")
    keys = stage(spark, entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "keys")
    directory, depth = build_directory(spark, keys.select("key"), capacity)
    slot = _slot(F.col("key"), depth)
    index = stage(spark, entries.withColumn("slot", slot).join(directory, "slot").drop("slot")
                  .sortWithinPartitions("bucket", "key"), "index")

    twice = keys.where("rows > 1").select("key")
    wanted = index.join(twice, "key", "left_semi").select("id")
    bodies = semi_join_ids(docs, wanted, "id").mapInArrow(_combined, "key long, body binary")
    owned = bodies.withColumn("slot", slot).join(directory.select("slot", "bucket"), "slot")
    chains = stage(spark, owned.repartition("bucket").sortWithinPartitions("bucket", "key").select("key", "body")
                   .mapInArrow(_chained, "key long, sha string, chain int"), "chains")

    named = index.join(chains, ["key", "sha"], "left").select(
        "id", "n_chars", "sha", "key", F.coalesce("chain", F.lit(1)).alias("chain"), *row)
    # a written table, so that the join below has plain exchanges, whose hot keys Spark can split
    groups = stage(spark, named.groupBy("key", "chain").agg(
        F.max(F.struct("n_chars", (-F.col("id")).alias("neg"), *row)).alias("best"), F.count(F.lit(1)).alias("size")), "kept")
    stays = F.col("id").eqNullSafe(-F.col("best.neg")) & (F.col("n_chars") == F.col("best.n_chars"))
    for c in row:
        stays = stays & (F.col(c) == F.col(f"best.{c}"))
    return named.join(groups, ["key", "chain"]).select(
        F.col("id").alias(id_col), (-F.col("best.neg")).alias("keep_id"), F.col("size").alias("group_size"),
        stays.alias("kept"), F.col("sha").alias("text_sha256"), *[F.col(c).alias(row_col) for c in row])
