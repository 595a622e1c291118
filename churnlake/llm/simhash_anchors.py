"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the words of a linear code over the 64 fingerprint bits. Every
fingerprint has one home, its nearest anchor, and is replicated to every
anchor within its distance to the code plus the threshold, which is at most
the covering radius plus the threshold. Two fingerprints x and y that differ
in at most t bits meet: let x be the one nearer to the code and a its home;
then d(a, y) <= d(a, x) + t <= d(y, code) + t, so y was sent to a. So
comparing the residents of an anchor with all fingerprints sent to it finds
every pair, and nothing else needs to be compared.

The code is spanned by hashes of 1, 2, ..., ``dimension``: random linear codes
cover nearly as well as any, and the nearest anchors are found by comparing
with all 2 ** dimension words. A larger dimension makes more replicas and
fewer comparisons (about 38 replicas and 0.9 % of all residents met with 12,
98 and 0.15 % with 16), so it follows the number of different fingerprints.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import connected_components, few_rows, host_guest_blocks, runs, stage

SEED = 42
#: Residents and guests of an anchor that meet in one block.
BLOCK = 4096
#: Different fingerprints up to which the code has 2 ** 12 words; beyond it 2 ** 16.
SMALL = 1 << 23
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; repeated shingles count each time."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at: at + _CHUNK], ends[at: at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        even = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[:even].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[even:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


@functools.lru_cache(4)
def anchors(dimension: int) -> np.ndarray:
    """The 2 ** dimension code words as uint64, the zero word first."""
    words = np.zeros(1, np.uint64)
    for i in range(dimension):
        words = np.concatenate([words, words ^ np.uint64(xxhash.xxh64_intdigest(b"anchor %d" % i))])
    return words


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["id", "fp"])
    return run


def replicas(fps: np.ndarray, code: np.ndarray, bits: int):
    """(row, anchor) of every replica of the fingerprints, and the home of each."""
    apart = np.bitwise_count(fps[:, None] ^ code[None, :])
    near = apart.min(axis=1)
    row, anchor = np.nonzero(apart <= near[:, None] + bits)
    return row, anchor, apart.argmin(axis=1)


def _sent(dimension: int, bits: int):
    """Batches of fingerprints -> (anchor, host, fp): one host row at home, guest rows at every anchor in reach."""
    def run(batches):
        code = anchors(dimension)
        step = max(1, (1 << 18) // len(code))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64 * step):
                parts = []
                for lo in range(at, min(at + 64 * step, len(fps)), step):
                    some = fps[lo: lo + step]
                    row, anchor, home = replicas(some, code, bits)
                    parts.append((home, np.ones(len(some), bool), some))
                    parts.append((anchor, np.zeros(len(row), bool), some[row]))
                anchor, host, fp = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(host), pa.array(fp.view(np.int64))],
                    ["anchor", "host", "fp"])
    return run


def joined_pairs(hosts: np.ndarray, guests: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (host, guest) within ``bits`` that span the components of all such links (at most one a node).

    A host in reach of several guests is linked with one guest of each
    component found so far, and these become one, so a group of copies
    gives a tree and not all of its pairs.
    """
    label, out = np.arange(len(guests)), []
    for at in range(0, len(hosts), 256):
        apart = np.bitwise_count(hosts[at: at + 256, None] ^ guests[None, :])
        close = apart <= bits
        for r in np.nonzero(close.sum(axis=1) > (apart == 0).sum(axis=1))[0]:  # somebody besides itself
            host, to = hosts[at + r], np.nonzero(close[r])[0]
            own = label[to[guests[to] == host]]  # its own guest row may lie in another block
            parts, first = np.unique(label[to], return_index=True)
            fresh = ~np.isin(parts, own)
            if fresh.any():
                out += [(host, guests[g]) for g in to[first[fresh]]]
                label[np.isin(label, parts)] = parts[0]
    return out


def _compared(bits: int):
    def run(batches):
        found = []
        for t in runs(batches, 3):
            host = t.column("host").to_numpy()
            fp = t.column("fp").to_numpy().view(np.uint64)
            if host.any():
                found += joined_pairs(fp[host], fp[~host], bits)
            if len(found) > 50_000:
                yield _links(found)
                found = []
        if found:
            yield _links(found)
    return run


def _links(found) -> pa.RecordBatch:
    both = np.array(found, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def simhash_links(spark: SparkSession, fps: DataFrame, bits: int = 4, dimension: int | None = None,
                  block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct) with the components of all links within ``bits``."""
    if dimension is None:
        dimension = 12 if fps.count() <= SMALL else 16
    sent = stage(spark, fps.select("fp").mapInArrow(_sent(dimension, bits), "anchor int, host boolean, fp long"),
                 "simhash_sent")
    sizes = sent.groupBy("anchor").agg(F.count_if("host").alias("hosts"), F.count_if(~F.col("host")).alias("guests"))
    dealt = host_guest_blocks(sent, sizes, ["anchor"], block, "fp")
    return stage(spark, dealt.mapInArrow(_compared(bits), "a long, b long"), "simhash_links")


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = 4, bits: int = 4, dimension: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id_col, fp, component_id, n_equal, n_near): near-duplicate classes by SimHash.

    ``fp`` is the signed 64-bit fingerprint over ``width``-word shingles;
    documents link when their fingerprints differ in at most ``bits`` bits.
    ``component_id`` is the smallest id reachable by links, ``n_equal`` the
    number of rows with the same fingerprint and ``n_near`` the number of
    different fingerprints in the component. Equal fingerprints are one node,
    so copies are never paired.

    Defined results: null, empty or blank text has the fingerprint zero and
    links like any other; rows that repeat an id are rows of their own; a null
    id counts for nothing in the smallest id (a component of null ids alone
    has a null component_id); extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = stage(spark, docs.mapInArrow(_fingerprints(width), "id long, fp long"), "simhash")
    nodes = stage(spark, base.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash_nodes")
    comp = stage(spark, connected_components(spark, simhash_links(spark, nodes, bits, dimension, block)), "simhash_comp")
    grouped = nodes.join(comp, nodes["fp"] == comp["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    heads = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_near"))
    # a fingerprint of one row that links with nothing needs no partner in the last join
    named = stage(spark, grouped.join(heads, "component").where("n > 1 or n_near > 1").select(
        F.col("fp").alias("__fp"), "component_id", F.col("n").alias("n_equal"), "n_near"), "simhash_named")
    out = base.join(F.broadcast(named) if few_rows(named) else named, F.col("fp") == F.col("__fp"), "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("__fp").isNull(), F.col("id"))
                      .otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("n_equal", F.lit(1)).alias("n_equal"), F.coalesce("n_near", F.lit(1)).alias("n_near"))
