"""Near-duplicate sets by PartEnum signatures (exact Jaccard threshold join).

A Jaccard similarity of at least t between sets of a and b shingles means a
symmetric difference of at most (1-t)/(1+t) * (a+b). Set sizes are cut into
bands; inside a band the difference has one bound k. The 64-bit shingle
domain is cut into n1 first-level parts of n2 second-level parts each. Since
more than k // (k2+1) first-level parts can't hold over k2 differences each,
two similar sets agree, in some first-level part, on all but k2 of its
second-level parts; so each set emits one signature for every choice of
n2-k2 second-level parts, and similar sets share at least one.

Bands go by the smaller set of a pair, so a set also emits signatures for the
band below when a partner may lie there. There are some more parts than the
bound needs, so similar sets share several signatures, and a set that shares
too few of them with anybody (a common passage, say) leaves before any pair
is formed.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.common import connected_components, semi_join_ids, stage

_M1, _M2, _MUL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    A-Z are lower-cased, words are split at ASCII white space. Fewer words
    than ``width``: the whole sequence is the only element; none: empty.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    h = w[: n - width + 1]
    for i in range(1, width):
        h = mix64(h * _MUL + w[i: n - width + 1 + i])
    return np.unique(h)


class PartEnum:
    """Bands and partition numbers for a threshold of ``percent`` / 100."""

    GROWTH = 1.5  # ratio of a band's ends
    EXTRA = 3  # signatures that a set may share by chance, beyond the empty ones

    def __init__(self, percent: int):
        self.percent, self.low, self.plans = percent, [1], {}

    def _reach(self, band: int) -> None:
        while len(self.low) < band + 2:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.GROWTH)))

    def bands(self, n: int) -> list[int]:
        """Bands whose pairs (by their smaller set) a set of n elements can belong to."""
        own = 0
        self._reach(own)
        while self.low[own + 1] <= n:
            own += 1
            self._reach(own)
        first = own
        while first and (self.low[first] - 1) * 100 >= self.percent * n:  # the largest set of the band before
            first -= 1
        return list(range(first, own + 1))

    def plan(self, band: int):
        """(n1, n2, chosen second-level parts, spare) of a band; None if only equal sets can be similar.

        k differences spoil at most all but ``spare + 1`` signatures of a set
        (one signature each for n2 = 2; for n2 > 2 the first difference in a
        part spoils n2 - 1 and the second the last). So a set with at most
        ``spare`` empty signatures may drop these and still shares more than
        ``spare`` less their number with any similar partner; the few sets
        with more empty ones keep them all. n1 and n2 give the fewest
        signatures with enough spare ones.
        """
        if band not in self.plans:
            self._reach(band)
            lo, hi = self.low[band], self.low[band + 1] - 1
            k = (100 - self.percent) * (hi + hi * 100 // self.percent) // (100 + self.percent)
            best = None
            for n2 in (2, 3, 4) if k else ():
                n1 = k // 2 + 1
                while True:
                    spare = (n1 * n2 - k * (n2 - 1) if k <= n1 else 2 * n1 - k) - 1
                    mean = n1 * n2 * math.exp(-lo * (n2 - 1) / (n1 * n2))
                    if mean + 3 * math.sqrt(mean) + self.EXTRA * (k > 8) <= max(spare, 0.5) or n1 > 2 * k + 8:
                        break
                    n1 += 1
                if best is None or n1 * n2 < best[0] * best[1]:
                    best = (n1, n2, list(combinations(range(n2), n2 - 1)), spare)
            self.plans[band] = best
        return self.plans[band]

    def signatures(self, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(slack, 64-bit signatures with the band in the low 6 bits) of a sorted set (uint64), by band.

        A similar set shares more than ``slack`` of them.
        """
        out = []
        if not len(h):
            return out
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + _MUL), dtype=np.uint64)])
        for band in self.bands(len(h)):
            plan = self.plan(band)
            if plan is None:
                continue
            n1, n2, subsets, spare = plan
            # parts are ranges of the hash domain, so a sorted set is cut by position
            cell = ((h >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
            at = np.searchsorted(cell, np.arange(n1 * n2 + 1, dtype=np.uint64))
            sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2)
            sizes = np.diff(at).reshape(n1, n2)
            part = np.arange(n1, dtype=np.uint64) * np.uint64(len(subsets))
            sig = np.stack([mix64(sums[:, s].sum(axis=1, dtype=np.uint64)
                                  + mix64(part + np.uint64(i + (band << 40)))) for i, s in enumerate(subsets)])
            sig = (sig & ~np.uint64(63)) | np.uint64(band & 63)
            full = np.stack([sizes[:, s].sum(axis=1) > 0 for s in subsets])
            left = spare - int((~full).sum())
            out.append((max(left, 0), sig[full] if left >= 0 else sig.ravel()))
        return out


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))


def _lists(values: list[np.ndarray], kind=np.int64) -> pa.Array:
    flat = np.concatenate(values) if values else np.empty(0, kind)
    return pa.ListArray.from_arrays(_offsets([len(v) for v in values]), pa.array(flat.view(kind)))


def _bands(made: list[list[tuple[int, np.ndarray]]]) -> pa.Array:
    """list<struct<slack, sigs>> of each set."""
    flat = [b for m in made for b in m]
    rows = pa.StructArray.from_arrays([pa.array([b[0] for b in flat], pa.int32()), _lists([b[1] for b in flat])],
                                      ["slack", "sigs"])
    return pa.ListArray.from_arrays(_offsets([len(m) for m in made]), rows)


def _described(width: int, percent: int, with_set: bool, with_sigs: bool):
    """Batches of (id, text) -> (id, set size and class, signatures), as asked for."""
    def run(batches):
        scheme = PartEnum(percent)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at in range(0, b.num_rows, 1000):
                sets = [shingle_set(t, width) for t in texts.slice(at, 1000).to_pylist()]
                out = {"id": b.column(0).slice(at, 1000)}
                if with_set:
                    out["n"] = pa.array([len(s) for s in sets], pa.int64())
                    out["cls"] = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                                          pa.binary())
                if with_sigs:
                    out["bands"] = _bands([scheme.signatures(s) for s in sets])
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def _sets(width: int, narrow: bool):
    """Sets as sorted items with their true size n: 64-bit, or ``narrow``: the different 32-bit heads."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at in range(0, b.num_rows, 1000):
                sets = [shingle_set(t, width) for t in texts.slice(at, 1000).to_pylist()]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                if narrow:
                    sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1000), sizes, _lists(sets, np.int32 if narrow else np.int64)],
                    ["id", "n", "items"])
    return run


def _sets_of(spark: SparkSession, docs: DataFrame, pairs: DataFrame, width: int, narrow: bool) -> DataFrame:
    """(id, n, items): shingle sets of the documents in pairs (a, b), made again for these rows only."""
    ids = stage(spark, pairs.select(F.col("a").alias("id")).unionByName(
        pairs.select(F.col("b").alias("id"))).distinct(), "pair_ids")
    return stage(spark, semi_join_ids(docs, ids, "id").mapInArrow(
        _sets(width, narrow), f"id long, n int, items array<{'int' if narrow else 'long'}>"), "pair_sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets x of a and y of b, and their true sizes xn and yn."""
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x"), F.col("n").alias("xn")), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("y"), F.col("n").alias("yn")), "b")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with nb, h and linked: true size of b, difference of the items, and whether the sets may be similar.

    Elements with one 32-bit head count once, so heads in common may be fewer
    than elements in common, by no more than either set lost; with that many
    more the test never says no to similar sets (and is exact for 64 bits).
    Different heads stand for different elements, so h is at most the true
    difference.
    """
    lost = F.least(F.col("xn") - F.size("x"), F.col("yn") - F.size("y"))
    both = _with_sets(pairs, sets).select(
        *pairs.columns, F.col("xn").alias("na"), F.col("yn").alias("nb"), lost.alias("lost"),
        (F.size("x") + F.size("y")).alias("heads"), F.size(F.array_intersect("x", "y")).alias("i"))
    most = F.col("i") + F.col("lost")
    return both.select(*pairs.columns, "nb", (F.col("heads") - 2 * F.col("i")).alias("h"),
                       (100 * most >= percent * (F.col("na") + F.col("nb") - most)).alias("linked"))


def _linked(spark: SparkSession, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that the 32-bit items call similar and the 64-bit items confirm."""
    pairs = stage(spark, pairs.select("a", "b"), "likely")
    return stage(spark, _compared(pairs, _sets_of(spark, docs, pairs, width, False), percent)
                 .where("linked").select("a", "b"), "links")


def _differences(spark: SparkSession, seen: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(key, b, nb, h, c, comp_b, is_near, is_far): what distinguishes documents from the leader that they were compared with.

    Two documents of one leader that may still link two components share a
    key (leader and element), on the near side of one and the far side of the
    other.

    With D = set Δ leader, |x Δ y| = |Dx| + |Dy| - 2 |Dx ∩ Dy|. A link allows
    |x Δ y| <= k, so Dx and Dy share at least o = (|Dx| + |Dy| - k) / 2
    elements, and o >= 1 unless both link to the leader. An element that only
    documents of one component have is in no such intersection, so D keeps its
    c elements that cross components, and a document with c < o leaves. In one
    order of the elements (the rarest of the leader's first), the first
    c - o + 1 elements of both then share one. So pairs are found by such
    elements, not by being together in a group, and documents that differ from
    the leader each in their own way make few pairs.
    """
    label = comp.select(F.col("node").alias("b"), "component")
    rows = seen.join(label, "b", "left").withColumn("comp_b", F.coalesce("component", "b")).drop("component")
    label = comp.select(F.col("node").alias("a"), "component")
    rows = stage(spark, rows.join(label, "a", "left").withColumn("comp_a", F.coalesce("component", "a"))
                 .drop("component"), "led")
    leaders = rows.groupBy("a").agg(
        (F.max(F.col("comp_a") != F.col("comp_b")) & (F.count(F.lit(1)) > 1)).alias("open"),
        F.min(F.when(~F.col("linked"), F.col("h"))).alias("h_out")).where("open").select("a", "h_out")
    rows = rows.join(leaders, "a")
    k = F.floor((100 - percent) * (F.col("nb") + F.floor(F.col("nb") * 100 / percent)) / (100 + percent))
    partner = F.when(F.col("linked"), F.greatest("h", "h_out")).otherwise(F.col("h"))
    # shared elements that a partner at least as far from the leader, and one at most as far, must have
    rows = rows.withColumn("k", k).withColumn("o_near", F.greatest(F.ceil((F.col("h") + partner - F.col("k")) / 2), F.lit(1))) \
        .withColumn("o_far", F.when(F.col("h") >= F.col("h_out"), F.greatest(F.col("h") - F.col("k"), F.lit(1))))
    rows = _with_sets(rows.where("h >= o_near or h >= o_far"), sets).select(
        "a", "b", "nb", "h", "comp_b", "o_near", "o_far",
        F.explode(F.concat(F.array_except("y", "x"), F.array_except("x", "y"))).alias("element"))
    rows = stage(spark, rows.withColumn("key", F.xxhash64("a", "element")).drop("element"), "elements")
    crossing = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("comp_b").alias("hi"),
                                       F.min("comp_b").alias("lo")).where("hi != lo").select("key", "m")
    of = ["a", "b", "nb", "h", "comp_b", "o_near", "o_far"]
    sides = rows.join(crossing, "key").groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("keys")) \
        .withColumn("c", F.size("keys"))
    near, far = F.col("c") - F.col("o_near") + 1, F.coalesce(F.col("c") - F.col("o_far") + 1, F.lit(0))
    sides = sides.withColumn("near", near).withColumn("far", far).where("near > 0 or far > 0")
    rows = sides.select("b", "nb", "h", "c", "comp_b", "near", "far", F.posexplode(F.slice(
        "keys", F.lit(1), F.greatest("near", "far").cast("int"))).alias("at", "e"))
    return stage(spark, rows.select(F.col("e.key").alias("key"), "b", "nb", "h", "c", "comp_b",
                                    (F.col("at") < F.col("near")).alias("is_near"),
                                    (F.col("at") < F.col("far")).alias("is_far")), "differences")


def _may_link(x: str, y: str, percent: int):
    """Whether documents x and y of one leader can be similar by their sizes, differences and crossing elements."""
    nx, ny, hx, hy, cx, cy = (F.col(f"{side}.{c}") for c in ("nb", "h", "c") for side in (x, y))
    k = F.floor((100 - percent) * (nx + ny) / (100 + percent))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (hx + hy - 2 * F.least(cx, cy) <= k)


def _relabelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with comp_b by the components found since."""
    label = comp.select(F.col("node").alias("b"), "component")
    return rows.join(label, "b", "left").withColumn("comp_b", F.coalesce("component", "comp_b")).drop("component")


#: Rounds with a further leader before documents are paired.
STARS = 3


def _star_pairs(spark: SparkSession, rows: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (a, b) of each document with a further leader of its key: the least different one, then others by hash.

    At most one pair for each row of ``rows``. Documents that share a
    difference from their leader are mostly alike (copies of one variant), so
    this joins them and leaves few components to pair.
    """
    order = F.xxhash64(F.lit(number), "b") if number else F.col("h").cast("long")
    least = F.min(F.struct(order.alias("order"), "b", "nb", "h", "c", "comp_b")).alias("s")
    second = rows.groupBy("key").agg(least, F.max("comp_b").alias("hi"), F.min("comp_b").alias("lo")) \
        .where("hi != lo").select("key", "s")
    pairs = rows.alias("r").join(second, "key").where((F.col("r.comp_b") != F.col("s.comp_b")) & _may_link("r", "s", percent))
    return stage(spark, pairs.select(F.least("r.b", "s.b").alias("a"), F.greatest("r.b", "s.b").alias("b")).distinct(),
                 "star_pairs")


def _second_pairs(spark: SparkSession, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key of ``_differences``."""
    open_ = rows.groupBy("key").agg(F.max("comp_b").alias("hi"), F.min("comp_b").alias("lo")).where("hi != lo").select("key")
    rows = stage(spark, rows.join(open_, "key", "left_semi"), "open_differences")
    near, far = rows.where("is_near").alias("n"), rows.where("is_far").alias("f")
    pairs = near.join(far, (F.col("n.key") == F.col("f.key")) & (F.col("n.comp_b") != F.col("f.comp_b"))
                      & (F.col("n.h") <= F.col("f.h")) & _may_link("n", "f", percent))
    return stage(spark, pairs.select(F.least("n.b", "f.b").alias("a"), F.greatest("n.b", "f.b").alias("b")).distinct(),
                 "second_pairs")


def _with_partners(members: DataFrame) -> DataFrame:
    """Rows (id, sig, slack) of shared signatures -> those of sets that share more of a band than their slack.

    Similar sets agree in more signatures than a set may lose, so a set that
    shares no more than its slack (a common passage, say) has no partner in
    that band.
    """
    rows = members.withColumn("band", F.col("sig").bitwiseAND(F.lit(63)).cast("int"))
    able = rows.groupBy("id", "band").agg(F.count_distinct("sig").alias("shared"), F.max("slack").alias("slack")) \
        .where("shared > slack").select("id", "band")
    return rows.join(able, ["id", "band"], "left_semi").select("id", "sig")


def near_duplicate_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                              text_col: str = "text", width: int = 5, percent: int = 80,
                              keep_signatures: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, class_size): connected components of similar documents.

    Documents link when 100 * |A ∩ B| >= percent * |A ∪ B| over their
    distinct ``width``-word shingles (64-bit hashes); component_id is the
    smallest id reachable. Every link between different sets counts, but a
    group that shares a signature is not expanded into pairs: equal sets are
    one class, the members of a group are compared with a leader (the one in
    most and largest groups), and only members that this leaves in different
    components are looked at again, by what distinguishes them from their
    leader. ``keep_signatures`` stores the signatures (8 bytes each) in the
    shared folder in place of making them again for each use.

    Defined results: null, empty or blank text has an empty set, links with
    nothing and is its own component; a null id gets a null component and
    carries no link; rows that repeat an id are one node; extra columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bands = "bands array<struct<slack: int, sigs: array<long>>>"
    schema = "id long, n long, cls binary" + f", {bands}" * keep_signatures
    base = stage(spark, docs.mapInArrow(_described(width, percent, True, keep_signatures), schema), "sets")
    classes = stage(spark, base.where("n > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"))
        .where("rep is not null"), "classes")
    rep_ids = classes.select(F.col("rep").alias("id"))
    if keep_signatures:
        signed = semi_join_ids(base.select("id", "bands"), rep_ids, "id")
    else:
        signed = semi_join_ids(docs, rep_ids, "id").mapInArrow(
            _described(width, percent, False, True), f"id long, {bands}")
    rows = signed.select("id", F.explode("bands").alias("b")).select("id", "b.slack", F.explode("b.sigs").alias("sig"))
    # one exchange of (id, slack, sig) rows; a signature of one set is gone after it
    shared = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    members = stage(spark, rows.withColumn("m", shared).where("m > 1").drop("m"), "groups")
    members = stage(spark, _with_partners(members), "members")
    sizes = members.groupBy("sig").agg(F.count_distinct("id").alias("m")).where("m > 1")
    members = stage(spark, members.join(sizes, "sig"), "members")
    weight = members.groupBy("id").agg(F.sum("m").alias("weight"))
    leaders = members.join(weight, "id").groupBy("sig").agg(
        F.max(F.struct("weight", (-F.col("id")).alias("neg"))).alias("lead")).select("sig", (-F.col("lead.neg")).alias("a"))
    pairs = members.join(leaders, "sig").where("id != a").groupBy("a", F.col("id").alias("b")).agg(
        F.max("m").alias("m"))
    # a pair that was alone in its groups only matters if its sizes allow a link
    sizes = classes.groupBy(F.col("rep").alias("of")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = pairs.join(sizes.toDF("a", "a0", "a1"), "a").join(sizes.toDF("b", "b0", "b1"), "b")
    pairs = stage(spark, pairs.where((F.col("m") > 2) | (F.col("a1") * 100 >= F.col("b0") * percent)
                                     & (F.col("b1") * 100 >= F.col("a0") * percent)).select("a", "b", "m"), "pairs")
    sets = _sets_of(spark, docs, pairs, width, True)
    seen = stage(spark, _compared(pairs, sets, percent), "compared")
    links = _linked(spark, docs, seen.where("linked"), width, percent)
    comp = connected_components(spark, links)
    # two members of a group besides its leader may be similar where the leader is not
    seen = seen.where("m > 2").drop("m", "linked").join(links.withColumn("link", F.lit(True)), ["a", "b"], "left") \
        .withColumn("linked", F.coalesce("link", F.lit(False))).drop("link")
    apart = _differences(spark, seen, sets, comp, percent)
    for number in range(STARS + 1):
        more = _star_pairs(spark, apart, percent, number) if number < STARS else _second_pairs(spark, apart, percent)
        if not more.isEmpty():
            likely = _compared(more, sets, percent).where("linked")
            links = links.unionByName(_linked(spark, docs, likely, width, percent))
            comp = stage(spark, connected_components(spark, links), "components")
            apart = _relabelled(apart, comp)
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select(
        "cls", "size", F.coalesce("component", "rep").alias("component"))
    return base.select("id", "n", "cls").join(named, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce("size", F.lit(1)).alias("class_size"))
