"""Classification trees grown level by level over binned rows: one tree, random forest, extra-trees.

A fit (a set of training rows, a fold's say) of at most ``block_rows`` rows is
one block, whose counts need no exchange: a task holds it and grows its share
of the trees, their rows kept by node. Above that, all trees grow together and
a level is one job: tasks route their
rows through the trees so far and emit counts by (tree, node, feature, bin),
added up before and after one exchange; running counts over a feature's bins
give every candidate cut its children, and the best one of a node is a
grouped maximum. Both ways give the same trees. Only the chosen splits come to
the driver, at most ``trees * 2 ** max_depth`` of them whatever the number of
rows, and a forest holds the nodes that there are.

Nothing is drawn at random: bootstrap counts, the features a node looks at and
the one cut an extra-tree tries per feature are hashes of (seed, tree, row,
node, feature) in whole numbers below 2 ** 62, which SQL can repeat. Ties go
to the first feature, then the lowest cut.
"""

from __future__ import annotations

import pickle
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2_147_483_647
# The chance that a row is drawn at most k times in a bootstrap (Poisson with mean 1), times PRIME.
DRAWN = [790_015_084, 1_580_030_168, 1_975_037_710, 2_106_706_891, 2_139_624_186, 2_146_207_645, 2_147_304_888]

#: Rows whose counts a task adds up before they are exchanged.
ROWS_COUNTED = 100_000
#: Training rows of a fit that make one block (some 60 bytes a row, of which 34 are its bins).
BLOCK_ROWS = 4_000_000
#: Rows of a node that are counted by themselves; smaller nodes are counted together.
ROWS_ALONE = 1024
#: Positives are counted in one float above the bits of the rows (at most 7 times 4,000,000).
PACKED = float(1 << 26)


@dataclass(frozen=True)
class TreeSettings:
    """``features`` a node looks at (None: all), ``bootstrap`` draws, one ``random_cut`` a feature in place of the best."""

    trees: int = 1
    max_depth: int = 8
    min_leaf: int = 20
    features: int | None = None
    bootstrap: bool = False
    random_cut: bool = False
    seed: int = 42
    bins: int = 32


def mix(h, x):
    """A hash below PRIME from a hash and a number (numbers or int64 arrays)."""
    h = (h * 1103515245 + x % PRIME * 12345 + 1013904223) % PRIME
    h = (h * 48271 + h // 65536) % PRIME
    return (h * 69621 + h // 32768) % PRIME


def draws(settings: TreeSettings, ids: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
    """(rows, trees): how often each tree's bootstrap holds each row."""
    trees = np.arange(settings.trees, dtype=np.int64) if trees is None else trees
    if not settings.bootstrap:
        return np.ones((len(ids), len(trees)), np.int64)
    h = mix(mix(settings.seed, 1 + trees)[None, :], ids[:, None])
    return np.searchsorted(np.array(DRAWN), h, side="right")


def looked_at(s: TreeSettings, n_features: int, tree, node: np.ndarray) -> np.ndarray:
    """(nodes, features): the features each node (by heap number) looks at, ascending."""
    every = np.arange(n_features, dtype=np.int64)
    if s.features is None or s.features >= n_features:
        return np.broadcast_to(every, (len(node), n_features))
    h = mix(mix(mix(s.seed + 1, 1 + tree % s.trees), node)[:, None], every[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, : s.features], axis=1)


def cut_hashes(s: TreeSettings, tree, node: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """(nodes, features): what the one cut of a node and feature is drawn by."""
    return mix(mix(mix(s.seed + 2, 1 + tree % s.trees), node)[:, None], looked.astype(np.int64))


@dataclass
class Forest:
    """Trees as rows of arrays, those of one fit after another's; a tree's nodes lie by level, in the order of their parents.

    Feature -1 is a leaf; the children of a node lie at ``left`` and behind it. ``node`` is the heap number
    (children of i: 2 i + 1, 2 i + 2).
    """

    settings: TreeSettings
    n_features: int
    fits: list[int]

    def __post_init__(self):
        shape = (len(self.fits) * self.settings.trees, 1)
        self.used = np.ones(shape[0], np.int64)
        self.feature, self.cut = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.left, self.node = np.zeros(shape, np.int32), np.zeros(shape, np.int64)
        self.count, self.positive = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def split(self, t: np.ndarray, i: np.ndarray, feature, cut, nl, pl) -> None:
        """Nodes at ``i`` of trees ``t``, in ascending order, get their cut and children, of which the left holds (nl, pl)."""
        first = np.searchsorted(t, t)
        left = self.used[t] + 2 * (np.arange(len(t)) - first)
        self.used += 2 * np.bincount(t, minlength=len(self.used))
        if (more := self.used.max() - self.feature.shape[1]) > 0:
            for name, empty in (("feature", -1), ("cut", 0), ("left", 0), ("node", 0), ("count", 0), ("positive", 0)):
                setattr(self, name, np.pad(getattr(self, name), ((0, 0), (0, more)), constant_values=empty))
        self.feature[t, i], self.cut[t, i], self.left[t, i] = feature, cut, left
        for at, n, p in ((left, nl, pl), (left + 1, self.count[t, i] - nl, self.positive[t, i] - pl)):
            self.node[t, at] = 2 * self.node[t, i] + 1 + (at - left)
            self.count[t, at], self.positive[t, at] = n, p

    def routes(self) -> "Forest":
        """What routing takes of it."""
        out = Forest(self.settings, self.n_features, self.fits)
        out.feature, out.cut, out.left = self.feature, self.cut, self.left
        out.node = out.count = out.positive = None
        return out

    def put(self, tree: int, feature: np.ndarray, cut: np.ndarray, count: np.ndarray, positive: np.ndarray) -> None:
        """A grown tree, its nodes by level."""
        start, end = 0, 1
        self.count[tree, 0], self.positive[tree, 0] = count[0], positive[0]
        while start < end:
            i = start + np.flatnonzero(feature[start: end] >= 0)
            start = end
            if len(i):
                left = end + 2 * np.arange(len(i))
                self.split(np.full(len(i), tree), i, feature[i], cut[i], count[left], positive[left])
                end += 2 * len(i)

    def trees_of(self, place: int) -> np.ndarray:
        """Tree numbers of the fit at ``place``, as one row."""
        return np.arange(place * self.settings.trees, (place + 1) * self.settings.trees)[None, :]

    def route_tree(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """Where each row ends in one tree."""
        feature, cut, left = self.feature[tree], self.cut[tree], self.left[tree]
        node = np.zeros(len(bins), np.int64)
        rows = np.flatnonzero(feature[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def nodes(self) -> list[tuple[int, int, int, int, int, int]]:
        """(tree, node, feature, cut, rows, positives) of every node, by heap number."""
        t, i = np.nonzero(self.count)
        order = np.lexsort((self.node[t, i], t))
        t, i = t[order], i[order]
        return list(zip(t.tolist(), self.node[t, i].tolist(), self.feature[t, i].tolist(), self.cut[t, i].tolist(),
                        self.count[t, i].tolist(), self.positive[t, i].tolist()))

    def looked_at(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """(nodes, features): the features each node looks at, ascending."""
        return looked_at(self.settings, self.n_features, tree, node)


def _matrix(batch) -> np.ndarray:
    flat = batch.column("bins").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def block_of(batches, n: int, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` rows (customer_id, label, bins) of a partition: (ids, labels, bins by feature), with no other copy."""
    ids, label, bins, at = np.empty(n, np.int64), np.empty(n, np.int8), np.empty((n_features, n), np.int8), 0
    for b in batches:
        own = slice(at, at + b.num_rows)
        ids[own], label[own], bins[:, own] = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b).T
        at = own.stop
    return ids, label, bins


def _gathered(batches, rows: int):
    """Tables of at least ``rows`` rows, as far as there are so many."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _level_counts(shared, n_open: int):
    """Batches of (fit, customer_id, label, bins) -> (key, n, p): counts by (open node, looked-at feature, bin).

    A tree's cells are one range of keys, so ROWS_COUNTED rows are counted tree
    by tree in an array of that range, with no sorting; only cells that hold
    a row go on.
    """
    def run(batches):
        forest, slot, looked = shared.value
        s, wide = forest.settings, looked.shape[1] * forest.settings.bins
        offsets = np.arange(looked.shape[1]) * s.bins
        for b, place in ((x, i) for x in _gathered(batches, ROWS_COUNTED) for i in range(len(forest.fits))):
            own = np.flatnonzero(b.column(0).to_numpy() == forest.fits[place])
            ids, label, bins = b.column(1).to_numpy()[own], b.column(2).to_numpy()[own], _matrix(b)[own]
            for tree in forest.trees_of(place)[0]:
                opened = slot[tree][slot[tree] >= 0]
                if not len(opened):
                    continue
                first, size = int(opened.min()), (int(opened.max()) - int(opened.min()) + 1) * wide
                times = draws(s, ids, np.array([tree % s.trees]))[:, 0]
                at = slot[tree][forest.route_tree(bins, tree)]
                row = np.flatnonzero((at >= 0) & (times > 0))
                where, w = at[row], np.repeat(times[row], looked.shape[1])
                key = (((where - first) * wide)[:, None] + offsets + bins[row[:, None], looked[where]]).ravel()
                n = np.bincount(key, w, size)
                some = np.flatnonzero(n)
                p = np.bincount(key, w * np.repeat(label[row], looked.shape[1]), size)[some]
                yield pa.RecordBatch.from_arrays([pa.array(some + first * wide), pa.array(n[some].astype(np.int64)),
                                                  pa.array(p.astype(np.int64))], ["key", "n", "p"])
    return run


def _hashed(shared):
    """Batches of (cell) -> (cell, h): what the cut of a cell, a node's feature, is drawn by."""
    def run(batches):
        s, tree, node, looked = shared.value
        for b in batches:
            cell = b.column(0).to_numpy()
            k, j = np.divmod(cell, looked.shape[1])
            h = cut_hashes(s, tree[k], node[k], looked[k, j][:, None])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(h)], ["cell", "h"])
    return run


def _best_cuts(cells: DataFrame, settings: TreeSettings, n_looked: int, hashes: DataFrame | None) -> DataFrame:
    """(slot, j, bin, nl, pl, n, p): the chosen cut of each open node, from (key, n, p)."""
    c = cells.select(F.expr(f"key div {settings.bins}").alias("cell"), F.expr(f"key % {settings.bins}").alias("bin"), "n", "p")
    by = Window.partitionBy("cell")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.select("cell", "bin", F.sum("n").over(upto).alias("nl"), F.sum("p").over(upto).alias("pl"),
                 F.sum("n").over(by).alias("n"), F.sum("p").over(by).alias("p"),
                 F.min("bin").over(by).alias("low"), F.max("bin").over(by).alias("high"),
                 F.lead("bin").over(by.orderBy("bin")).alias("next"))
    if hashes is not None:  # the last bin at or below the one cut that this node tries on this feature
        cut = F.col("low") + F.col("h") % (F.col("high") - F.col("low"))
        c = c.join(hashes, "cell").where("high > low").withColumn("cut", cut) \
            .where((F.col("bin") <= F.col("cut")) & (F.col("next") > F.col("cut"))).withColumn("bin", F.col("cut"))
    c = c.where((F.col("nl") >= settings.min_leaf) & (F.col("n") - F.col("nl") >= settings.min_leaf)
                & (F.col("nl") < F.col("n")))
    ql, pr, nr = F.col("nl") - F.col("pl"), F.col("p") - F.col("pl"), F.col("n") - F.col("nl")
    qr = nr - pr
    score = (F.col("pl") * F.col("pl") + ql * ql) / F.col("nl") + (pr * pr + qr * qr) / nr
    best = F.max(F.struct(score.alias("score"), (-F.col("cell")).alias("first"), (-F.col("bin")).alias("low"),
                          "nl", "pl", "n", "p")).alias("b")
    return c.groupBy(F.expr(f"cell div {n_looked}").alias("slot")).agg(best).select(
        "slot", F.expr(f"(-b.first) % {n_looked}").alias("j"), (-F.col("b.low")).alias("bin"), "b.nl", "b.pl", "b.n", "b.p")


def _able(s: TreeSettings, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether nodes of n rows and p positives may be cut."""
    return (n >= max(2, 2 * s.min_leaf)) & (p > 0) & (p < n)


def _together(sizes: list[int], most: int):
    """(from, to) of runs of nodes that hold about ``most`` rows."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if total:
        yield lo, len(sizes)


def _counted(bins: np.ndarray, held: list[np.ndarray], packed: np.ndarray, looked: np.ndarray, n_bins: int) -> np.ndarray:
    """(nodes, looked-at features, bins): packed sums over the rows ``held`` by each node."""
    out = np.zeros((*looked.shape, n_bins))
    few = [k for k, rows in enumerate(held) if len(rows) < ROWS_ALONE]
    for k, rows in enumerate(held):
        if len(rows) >= ROWS_ALONE:
            for lo in range(0, len(rows), ROWS_COUNTED):
                part = rows[lo: lo + ROWS_COUNTED]
                weight = packed[part]
                for j, f in enumerate(looked[k].tolist()):
                    out[k, j] += np.bincount(bins[f].take(part), weight, n_bins)
    for lo, hi in _together([len(held[k]) for k in few], ROWS_COUNTED):
        part = few[lo: hi]
        rows = np.concatenate([held[k] for k in part])
        weight, slot = packed[rows], np.repeat(np.arange(len(part)), [len(held[k]) for k in part])
        for j in range(looked.shape[1]):
            cell = slot * n_bins + bins[looked[part, j][slot], rows]
            out[part, j] = np.bincount(cell, weight, len(part) * n_bins).reshape(-1, n_bins)
    return out


def _chosen(s: TreeSettings, sums: np.ndarray, drawn: np.ndarray | None):
    """(whether it has a cut, place of its feature, cut, nl, pl) of each node, as ``_best_cuts`` finds them."""
    p = np.floor(sums / PACKED)
    n = sums - p * PACKED
    nl, pl = np.cumsum(n, axis=2), np.cumsum(p, axis=2)
    nr, pr = nl[:, :, -1:] - nl, pl[:, :, -1:] - pl
    ok = (nl >= max(1, s.min_leaf)) & (nr >= max(1, s.min_leaf))
    if drawn is not None:
        low, high = (n > 0).argmax(axis=2), n.shape[2] - 1 - (n > 0)[:, :, ::-1].argmax(axis=2)
        cut = low + drawn % np.maximum(high - low, 1)
        ok &= (high > low)[:, :, None] & (np.arange(n.shape[2]) == cut[:, :, None])
    sides = ((nl, pl), (nr, pr))
    score = sum(np.divide(b * b + (a - b) * (a - b), a, out=np.zeros_like(a), where=ok) for a, b in sides)
    flat = np.where(ok, score, -1.0).reshape(len(score), -1)
    at = flat.argmax(axis=1)  # the first of equals: first feature, then lowest cut
    every = np.arange(len(at))
    pick = lambda v: v.reshape(len(at), -1)[every, at].astype(np.int64)
    return ok.any(axis=(1, 2)), at // n.shape[2], at % n.shape[2], pick(nl), pick(pl)


def _moved(bins: np.ndarray, held: list[np.ndarray], feature: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """The rows of both children of each node, one after the other."""
    out: list = [None] * (2 * len(held))
    few = [k for k, rows in enumerate(held) if len(rows) < ROWS_ALONE]
    for k, rows in enumerate(held):
        if len(rows) >= ROWS_ALONE:
            right = bins[feature[k]].take(rows) > cut[k]
            out[2 * k], out[2 * k + 1] = rows[~right], rows[right]
    for lo, hi in _together([len(held[k]) for k in few], ROWS_COUNTED):
        part = few[lo: hi]
        rows = np.concatenate([held[k] for k in part])
        slot = np.repeat(np.arange(len(part)), [len(held[k]) for k in part])
        side = 2 * slot + (bins[feature[part][slot], rows] > cut[part][slot])
        rows = rows[np.argsort(side.astype(np.uint16) if len(part) < 1 << 15 else side, kind="stable")]
        ends = np.cumsum(np.bincount(side, minlength=2 * len(part)))
        for i, k in enumerate(part):
            mid = ends[2 * i]
            out[2 * k], out[2 * k + 1] = rows[ends[2 * i - 1] if i else 0: mid], rows[mid: ends[2 * i + 1]]
    return out


def grow_tree(s: TreeSettings, tree: int, ids: np.ndarray, label: np.ndarray, bins: np.ndarray) -> tuple:
    """(feature, cut, rows, positives) of the nodes of one tree over a block; ``bins`` is (features, rows)."""
    times, one = np.empty(len(ids), np.int8), np.array([tree])
    for lo in range(0, len(ids), ROWS_COUNTED):
        times[lo: lo + ROWS_COUNTED] = draws(s, ids[lo: lo + ROWS_COUNTED], one)[:, 0]
    packed = np.multiply(label, PACKED, dtype=np.float64)
    packed += 1
    packed *= times
    held = [np.flatnonzero(times).astype(np.int32)]
    n, p = np.array([times.sum()]), np.array([times[label > 0].sum()])
    node, levels = np.zeros(1, np.int64), []
    for depth in range(s.max_depth + 1):
        feature, cut = np.full(len(n), -1, np.int16), np.zeros(len(n), np.int16)
        levels.append((feature, cut, n, p))
        on = np.flatnonzero(_able(s, n, p))
        if depth == s.max_depth or not len(on):
            break
        looked = looked_at(s, len(bins), tree, node[on])
        held = [held[k] for k in on]
        has, j, at, nl, pl = _chosen(s, _counted(bins, held, packed, looked, s.bins),
                                     cut_hashes(s, tree, node[on], looked) if s.random_cut else None)
        if not has.any():
            break
        j, at, nl, pl, cuts = looked[has, j[has]], at[has], nl[has], pl[has], on[has]
        feature[cuts], cut[cuts] = j, at
        if depth + 1 < s.max_depth:
            held = _moved(bins, [held[k] for k in np.flatnonzero(has)], j, at)
        both = lambda a, b: np.stack([a, b], axis=1).ravel()
        n, p, node = both(nl, n[cuts] - nl), both(pl, p[cuts] - pl), both(2 * node[cuts] + 1, 2 * node[cuts] + 2)
    return tuple(np.concatenate(part).astype(kind) for part, kind in zip(zip(*levels), (np.int16, np.int16, np.int32, np.int32)))


def _fit_blocks(rows: DataFrame, forest: Forest, sizes: dict[int, int]) -> None:
    """Trees of fits whose rows are one block each: jobs of one task, each with its share of a fit's trees, side by side."""
    s, sc = forest.settings, rows.sparkSession.sparkContext
    shares = min(s.trees, max(1, -(-2 * sc.defaultParallelism // len(sizes))))

    def grown(place, share):
        n, n_features = sizes[forest.fits[place]], forest.n_features

        def run(batches):
            ids, label, bins = block_of(batches, n, n_features)
            for tree in range(share, s.trees, shares):
                made = pickle.dumps(grow_tree(s, tree, ids, label, bins))
                yield pa.RecordBatch.from_pydict({"tree": pa.array([place * s.trees + tree], pa.int32()), "made": [made]})
        own = rows.where(F.col("fit") == forest.fits[place]).select("customer_id", "label", "bins").coalesce(1)
        return own.mapInArrow(run, "tree int, made binary").collect()

    parts = [(i, k) for i, f in enumerate(forest.fits) if f in sizes for k in range(shares)]
    with ThreadPoolExecutor(len(parts)) as pool:
        for made in pool.map(lambda part: grown(*part), parts):
            for r in made:
                forest.put(r["tree"], *pickle.loads(r["made"]))


def fit_forest(binned: DataFrame, n_features: int, settings: TreeSettings, fits: list[int] = [0],
               block_rows: int = BLOCK_ROWS) -> Forest:
    """Trees of every fit from the rows that train it: ``binned`` (fit, train, customer_id, label, bins).

    ``binned`` should be a written table: each task reads the rows of its fit once, or each level those of all fits.
    """
    forest = Forest(settings, n_features, list(fits))
    rows = binned.where("train").select("fit", "customer_id", F.col("label").cast("long").alias("label"), "bins")
    sizes = {r["fit"]: r["count"] for r in rows.where(F.col("fit").isin(*fits)).groupBy("fit").count().collect()}
    if max(sizes.values(), default=0) > block_rows:
        _fit_levels(rows, forest)
    elif sizes:
        _fit_blocks(rows, forest, sizes)
    return forest


def _fit_levels(rows: DataFrame, forest: Forest) -> None:
    """All trees of all fits together, one job a level."""
    spark, s = rows.sparkSession, forest.settings

    def totals(batches):
        for b, place in ((x, i) for x in batches for i in range(len(forest.fits))):
            own = np.flatnonzero(b.column(0).to_numpy() == forest.fits[place])
            times = draws(s, b.column(1).to_numpy()[own])
            y = b.column(2).to_numpy()[own]
            yield pa.RecordBatch.from_arrays([pa.array(forest.trees_of(place)[0]), pa.array(times.sum(axis=0)),
                                              pa.array((times * y[:, None]).sum(axis=0))], ["tree", "n", "p"])
    for r in rows.mapInArrow(totals, "tree long, n long, p long").groupBy("tree").agg(
            F.sum("n").alias("n"), F.sum("p").alias("p")).collect():
        forest.count[r["tree"], 0], forest.positive[r["tree"], 0] = r["n"], r["p"]
    lo = np.zeros(len(forest.used), np.int64)  # where the nodes of the level begin in each tree
    for _ in range(s.max_depth):
        place = np.arange(forest.feature.shape[1])
        tree, at = np.nonzero(_able(s, forest.count, forest.positive) & (place >= lo[:, None]))
        if not len(tree):
            break
        node = forest.node[tree, at]
        looked = forest.looked_at(tree, node)
        slot = np.full(forest.feature.shape, -1, np.int32)
        slot[tree, at] = np.arange(len(tree))
        shared = spark.sparkContext.broadcast((forest.routes(), slot, looked))  # bounded by trees and depth
        cells = rows.mapInArrow(_level_counts(shared, len(tree)), "key long, n long, p long").groupBy("key").agg(
            F.sum("n").alias("n"), F.sum("p").alias("p"))
        opened = spark.sparkContext.broadcast((s, tree, node, looked)) if s.random_cut else None
        hashes = None if opened is None else spark.range(looked.size).mapInArrow(_hashed(opened), "cell long, h long")
        best = _best_cuts(cells, s, looked.shape[1], hashes).toArrow()
        order = np.argsort(best.column("slot").to_numpy())
        of, j, cut, nl, pl = (best.column(c).to_numpy()[order] for c in ("slot", "j", "bin", "nl", "pl"))
        lo = forest.used.copy()
        for held in (shared, opened):
            if held is not None:
                held.destroy()
        if not len(of):
            break
        forest.split(tree[of], at[of], looked[of, j], cut, nl, pl)


def predict_forest(forest: Forest, binned: DataFrame, *keep: str) -> DataFrame:
    """(fit, *keep, score): the mean over the fit's trees of the share of positives in a row's leaf."""
    value = (forest.positive / np.maximum(forest.count, 1)).astype(np.float64)
    shared = binned.sparkSession.sparkContext.broadcast((forest.routes(), value))

    def run(batches):
        forest, value = shared.value
        step = max(1, 1_000_000 // forest.settings.trees)
        for b in batches:
            bins, fits, score = _matrix(b), b.column(0).to_numpy(), np.zeros(b.num_rows)
            for place, fit in enumerate(forest.fits):
                every = np.flatnonzero(fits == fit)
                for lo in range(0, len(every), step):
                    own = every[lo: lo + step]
                    part, each = bins[own], np.empty((forest.settings.trees, len(own)))
                    for k, tree in enumerate(forest.trees_of(place)[0]):
                        each[k] = value[tree, forest.route_tree(part, tree)]
                    score[own] = np.ascontiguousarray(each.T).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], ["fit", *keep, "score"])
    rows = binned.select("fit", *keep, "bins")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double")
