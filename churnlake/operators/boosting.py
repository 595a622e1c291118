"""Gradient-boosted trees on second-order histograms, several learners and fits at once.

Every run (a preset and a fit) boosts log-loss over binned rows. A step needs
the sums of gradients, hessians and rows by (run, node, feature, bin); these
are whole numbers (gradients in units of 2 ** -20), so any order of adding
them gives the same trees. Three ways to grow:

* by leaves: the leaf of largest gain is split next, up to ``leaves`` leaves.
  One step measures the children of every leaf that may still be split, so a
  tree takes as many steps as it is deep, not one a leaf;
* by depth: the same with ``depth`` levels and no limit on leaves;
* symmetric: one cut a level for all its nodes, so a row's leaf is a number
  read off ``depth`` comparisons.

Only the smaller child of a split is measured; the other is what is left of its
parent. A fit of at most ``block_rows`` rows is one block, whose sums need no
exchange, so its rounds run where the block is, one task a run. Above that, the
rows of a run are dealt to blocks that stay with the executors together with
their margins, and a step is one job for all runs: a task routes the rows of
its block through the tree that grows and returns their sums (a few thousand
numbers a node, whatever the number of rows). The first step of a round adds
the last tree to the margins; these are written every ``WRITE_EVERY`` rounds.
"""

from __future__ import annotations

import heapq
import math
import pickle
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators.forest import PRIME, block_of, mix
from churnlake.session import shared_dir

UNIT = float(1 << 20)
WRITE_EVERY = 25
#: Rows of a fit that make one block (some 115 bytes a row): one core adds them up sooner than a cluster starts the jobs of the steps.
BLOCK_ROWS = 4_000_000
#: Cells of columns that are added up as one: their sums stay in a core's own cache.
JOINED_CELLS = 1024
#: Rows whose hessians (at most 2 ** 18 units each) and number are added up in one float of 53 bits.
ROWS_PACKED = 1 << 16
PACKED = float(1 << 35)
#: Rows of a block where a step is a job.
STEP_ROWS = 200_000
#: Blocks of a step whose sums the driver adds up by itself.
FEW_BLOCKS = 64


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 250
    rate: float = 0.05
    leaves: int | None = 15
    depth: int | None = None
    symmetric: bool = False
    min_rows: int = 30
    min_hessian: float = 1e-3
    l2: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42
    bins: int = 32


# The settings of the four boosted learners.
PRESETS = {
    "gbt_hist": BoostSettings(rounds=250, leaves=15, min_rows=30, l2=1.0),
    "gbt_xgb": BoostSettings(rounds=400, leaves=None, depth=4, min_rows=1, min_hessian=3.0, l2=1.0, row_share=0.8,
                             column_share=0.8),
    "gbt_lgbm": BoostSettings(rounds=400, leaves=15, min_rows=30, l2=0.0, column_share=0.8),
    "gbt_catboost": BoostSettings(rounds=400, leaves=None, depth=6, symmetric=True, min_rows=1, l2=3.0),
}


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. ``sums`` holds (G, H, rows) in units."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    sums: list[tuple] = field(default_factory=lambda: [None])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, low, high) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for s in (low, high):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.sums.append(s)
            self.level.append(self.level[node] + 1)
        return at, at + 1

    def route(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[node]
            on = f >= 0
            if not on.any():
                return node
            right = bins[row, np.maximum(f, 0)] > cut[node]
            node = np.where(on, left[node] + right, node)


@dataclass
class Booster:
    settings: BoostSettings
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.base) if start is None else start.copy()
        columns = np.ascontiguousarray(bins.T)
        for tree in self.trees[since:]:
            out += tree_values(tree, moved(tree, columns, at_root(len(out))), len(out))
        return out

    def slim(self) -> "Booster":
        return Booster(self.settings, self.base, [replace(t, sums=[], level=[]) for t in self.trees])


@dataclass
class Scorer:
    """A booster as a function of bins."""

    booster: Booster

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.booster.margins(bins)))

    def replaced(self, own: np.ndarray, donor: np.ndarray, groups: dict[str, list[int]]):
        """(name, scores of ``own`` with a group's columns taken from ``donor``) of each group.

        A tree that cuts none of them keeps its values; margins are added up in the order of the trees, as ever.
        """
        own, donor = np.ascontiguousarray(own.T), np.ascontiguousarray(donor.T)
        trees = self.booster.trees
        values = [tree_values(t, moved(t, own, at_root(own.shape[1])), own.shape[1]) for t in trees]
        for name, places in groups.items():
            columns, here = list(own), set(places)
            for f in here:
                columns[f] = donor[f]
            margin = np.full(own.shape[1], self.booster.base)
            for t, value in zip(trees, values):
                margin += value if here.isdisjoint(t.feature) else \
                    tree_values(t, moved(t, columns, at_root(len(margin))), len(margin))
            yield name, 1 / (1 + np.exp(-margin))


def sampled(s: BoostSettings, round_no: int, ids: np.ndarray) -> np.ndarray:
    """Rows that a round learns from, by a hash of (seed, round, id)."""
    if s.row_share >= 1:
        return np.ones(len(ids), bool)
    seed, on = mix(s.seed, round_no), np.empty(len(ids), bool)
    for lo in range(0, len(ids), ROWS_PACKED):
        on[lo: lo + ROWS_PACKED] = mix(seed, ids[lo: lo + ROWS_PACKED]) < s.row_share * PRIME
    return on


def columns_of(s: BoostSettings, round_no: int, n_features: int) -> np.ndarray:
    """Features that a round's tree may use, by a hash of (seed, round, feature)."""
    if s.column_share >= 1:
        return np.ones(n_features, bool)
    h = mix(mix(s.seed + 1, round_no), np.arange(n_features, dtype=np.int64))
    keep = np.zeros(n_features, bool)
    keep[np.argsort(h, kind="stable")[: max(1, math.ceil(s.column_share * n_features))]] = True
    return keep


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of log-loss in whole units."""
    grad, hess = np.empty(len(margin)), np.empty(len(margin))
    for lo in range(0, len(margin), ROWS_PACKED):
        own = slice(lo, lo + ROWS_PACKED)
        p = 1 / (1 + np.exp(-margin[own]))
        grad[own], hess[own] = np.rint((p - label[own]) * UNIT), np.rint(p * (1 - p) * UNIT)
    return grad, hess


class Columns:
    """The bins of a block, (features, rows), with columns joined into one number where its values stay few.

    The sums over the cells of one column are those over the joined cells, added up along the other columns, so one
    pass over the rows serves all columns that are joined.
    """

    def __init__(self, bins: np.ndarray, widths: list[int]):
        self.bins, self.widths, self.joined = bins, widths, []  # (features, number of each row)
        groups: list[tuple[int, list[int]]] = []
        for f in sorted(range(len(widths)), key=lambda f: -widths[f]):  # first fit, the widest first
            at = next((k for k, (cells, _) in enumerate(groups) if cells * widths[f] <= JOINED_CELLS), len(groups))
            cells, own = groups[at] if at < len(groups) else (1, [])
            groups[at: at + 1] = [(cells * widths[f], [*own, f])]
        for cells, own in groups:
            number = np.zeros(bins.shape[1], np.int16 if cells <= 1 << 15 else np.int64)
            for f in own:
                number = number * number.dtype.type(widths[f]) + bins[f].astype(number.dtype)
            self.joined.append((own, number))


def cell_sums(columns: Columns, rows: dict[int, np.ndarray], nodes: list[int], on, grad, hess) -> np.ndarray:
    """(nodes, cells, 3): sums of (gradient, hessian, rows) over the rows of each of ``nodes``.

    A feature has as many cells as its width; ``on`` marks the rows that count.
    """
    shape = [[columns.widths[f] for f in own] for own, _ in columns.joined]
    sums, every = [np.zeros((len(nodes), 3, math.prod(w))) for w in shape], on.all()
    for k, node in enumerate(nodes):
        own = rows[node] if every else rows[node][on[rows[node]]]
        for start in range(0, len(own), ROWS_PACKED):
            part = own[start: start + ROWS_PACKED]
            g, both = grad[part], hess[part] + PACKED  # rows are counted above the bits of the hessians
            for (_, number), out in zip(columns.joined, sums):
                cell = number[part].astype(np.intp)
                out[k, 0] += np.bincount(cell, g, out.shape[2])
                packed = np.bincount(cell, both, out.shape[2])
                n = np.floor(packed / PACKED)
                out[k, 1] += packed - n * PACKED
                out[k, 2] += n
    ends = np.cumsum(columns.widths)
    out = np.empty((len(nodes), ends[-1] if len(ends) else 0, 3))
    for (own, _), w, part in zip(columns.joined, shape, sums):
        part = part.reshape(len(nodes), 3, *w)
        for i, f in enumerate(own):
            others = tuple(2 + j for j in range(len(own)) if j != i)
            out[:, ends[f] - w[i]: ends[f]] = part.sum(axis=others).transpose(0, 2, 1)
    return out


def moved(tree: Tree, bins: np.ndarray | list[np.ndarray], rows: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """``rows`` (node -> rows of ``bins`` (features, rows), ascending), moved down to where the tree ends."""
    split = [n for n in rows if tree.feature[n] >= 0]
    while split:
        n = split.pop()
        own, left = rows.pop(n), tree.left[n]
        high = bins[tree.feature[n]][own] > tree.cut[n]
        rows[left], rows[left + 1] = own[~high], own[high]
        split += [c for c in (left, left + 1) if tree.feature[c] >= 0]
    return rows


def at_root(n: int) -> dict[int, np.ndarray]:
    return {0: np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)}


def tree_values(tree: Tree, rows: dict[int, np.ndarray], n_rows: int) -> np.ndarray:
    """The value of the node that each row is at."""
    out = np.empty(n_rows)
    for n, own in rows.items():
        out[own] = tree.value[n]
    return out


def _gain(part: np.ndarray, l2: float) -> np.ndarray:
    g, h = part[..., 0] / UNIT, part[..., 1] / UNIT + l2
    return np.divide(g * g, h, out=np.zeros_like(h), where=h > 0)


def cut_gains(hist: np.ndarray, s: BoostSettings, columns: np.ndarray):
    """(gain of every (slot, feature, cut), sums left of it): -inf where a side is too small."""
    low = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :, None]
    high = total - low
    ok = (low[..., 2] >= max(1, s.min_rows)) & (high[..., 2] >= max(1, s.min_rows)) & columns[None, :, None]
    ok &= (low[..., 1] >= s.min_hessian * UNIT) & (high[..., 1] >= s.min_hessian * UNIT)
    gain = _gain(low, s.l2) + _gain(high, s.l2) - _gain(total, s.l2)
    return np.where(ok, gain, -np.inf), low, ok


class Growth:
    """One tree of one run: asks for the histograms of ``wanted`` nodes until it is ``done``.

    A tree by leaves takes the leaf of largest gain first (ties: the older
    node). It is measured ahead of what is split: every leaf in question is
    split provisionally, its children are measured in the next step, and what
    the order of gains doesn't reach is taken back at the end.
    """

    def __init__(self, s: BoostSettings, n_features: int, round_no: int):
        self.s, self.columns = s, columns_of(s, round_no, n_features)
        self.tree, self.wanted, self.done = Tree(), [0], False
        self.best: dict[int, tuple] = {}  # node -> (gain, feature, cut, low, high) or None where it can't be split

    def add(self, hist: np.ndarray) -> None:
        """Histograms of ``wanted``, in order."""
        if self.tree.sums[0] is None:
            self.tree.sums[0] = tuple(hist[0, 0].sum(axis=0))
        gain, low, ok = cut_gains(hist, self.s, self.columns)
        if self.s.symmetric:
            self._level(gain, low, ok)
            return
        for k, node in enumerate(self.wanted):
            at = int(np.argmax(gain[k]))  # the first of equals: smallest feature, then lowest cut
            f, c = divmod(at, gain.shape[2])
            self.best[node] = None
            if gain[k, f, c] > 1e-9 and (self.s.depth is None or self.tree.level[node] < self.s.depth):
                lo = low[k, f, c]
                self.best[node] = (gain[k, f, c], f, c, tuple(lo), tuple(np.array(self.tree.sums[node]) - lo))
        self._ahead()

    def _order(self) -> tuple[list[int], list[int]]:
        """Nodes that are split in the order of gains as far as it is known, and those it waits for."""
        if self.best.get(0) is None:
            return [], []
        heap, order, waits = [(-self.best[0][0], 0)], [], []
        while heap and (self.s.leaves is None or len(order) < self.s.leaves - 1):
            _, node = heapq.heappop(heap)
            order.append(node)
            left = self.tree.left[node]
            if not left:
                waits.append(node)
                continue
            for child in (left, left + 1):
                if self.best[child] is not None:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return order, waits

    def _ahead(self) -> None:
        order, waits = self._order()
        if waits:
            # all that the order reached so far, with the children unknown: measure these together
            self.wanted = []
            for node in sorted(set(waits)):
                _, f, c, low, high = self.best[node]
                for child, sums in zip(self.tree.split(node, f, c, low, high), (low, high)):
                    level = self.tree.level[child]
                    if (self.s.depth is not None and level >= self.s.depth) or sums[2] < 2 * max(1, self.s.min_rows):
                        self.best[child] = None
                    else:
                        self.wanted.append(child)
            if self.wanted:
                return
            self._ahead()
            return
        chosen = set(order)
        for node in range(len(self.tree.feature)):
            if node not in chosen:
                self.tree.feature[node] = -1  # measured, but not reached
        self._finish()

    def _level(self, gain, low, ok) -> None:
        # one cut for all nodes: a node that it would not split keeps its rows on one side and gains nothing
        total = np.where(ok, gain, 0.0).sum(axis=0)
        total[~ok.any(axis=0)] = -np.inf
        f, c = divmod(int(np.argmax(total)), total.shape[1])
        if total[f, c] > 1e-9:
            level = []
            for k, node in enumerate(self.wanted):
                lo = low[k, f, c]
                level += self.tree.split(node, f, c, tuple(lo), tuple(np.array(self.tree.sums[node]) - lo))
            if self.tree.level[-1] < self.s.depth:
                self.wanted = level
                return
        self._finish()

    def _finish(self) -> None:
        self.done, self.wanted = True, []
        for node, sums in enumerate(self.tree.sums):
            h = sums[1] / UNIT + self.s.l2
            self.tree.value[node] = -self.s.rate * (sums[0] / UNIT) / h if h > 0 else 0.0
        for node, left in enumerate(self.tree.left):
            if left and self.tree.feature[node] < 0:  # measured, but not reached: rows below belong to the node
                self.tree.value[left] = self.tree.value[left + 1] = self.tree.value[node]


def log_odds(n: int, positives: int) -> float:
    rate = min(max(positives / n if n else 0.5, 1e-6), 1 - 1e-6)
    return math.log(rate / (1 - rate))


class Run:
    """A run between its steps: the trees so far, and the one that grows with the sums known of its nodes."""

    def __init__(self, booster: Booster, widths: list[int]):
        self.booster, self.widths = booster, widths
        self.place = np.concatenate([f * booster.settings.bins + np.arange(w) for f, w in enumerate(widths)])
        self._next()

    def _next(self) -> None:
        self.growth = Growth(self.booster.settings, len(self.widths), len(self.booster.trees))
        self.known: dict[int, np.ndarray] = {}  # node -> (cells, 3)

    @property
    def done(self) -> bool:
        return len(self.booster.trees) >= self.booster.settings.rounds

    def asks(self) -> list[int]:
        """The nodes to measure: of a split, the child with fewer rows."""
        tree = self.growth.tree
        self.parent = {c: n for n, left in enumerate(tree.left) if left for c in (left, left + 1)}
        self.pairs = {}
        for n in self.growth.wanted:
            if n == 0:
                self.pairs[0] = (0, None)
            else:
                left = tree.left[self.parent[n]]
                low, high = tree.sums[left][2], tree.sums[left + 1][2]
                self.pairs[left] = (left, left + 1) if low <= high else (left + 1, left)
        return [few for few, _ in self.pairs.values()]

    def take(self, sums: np.ndarray) -> bool:
        """The sums of what it asked for, in order; whether the tree is complete."""
        for cells, (few, rest) in zip(sums, self.pairs.values()):
            self.known[few] = cells
            if rest is not None:
                self.known[rest] = self.known[self.parent[rest]] - cells
        s, growth = self.booster.settings, self.growth
        hist = np.zeros((len(growth.wanted), len(self.widths) * s.bins, 3))
        hist[:, self.place] = [self.known[n] for n in growth.wanted]
        growth.add(hist.reshape(len(hist), len(self.widths), s.bins, 3))
        if growth.done:
            self.booster.trees.append(growth.tree)
            if not self.done:
                self._next()
        return growth.done


def _widths(most: np.ndarray) -> list[int]:
    return [int(b) + 1 for b in most]


def boost_block(s: BoostSettings, ids: np.ndarray, label: np.ndarray, bins: np.ndarray) -> Booster:
    """All rounds of one run over one block of rows."""
    bins = np.ascontiguousarray(bins.T)
    run = Run(Booster(s, log_odds(len(label), int(label.sum()))), _widths(bins.max(axis=1)))
    columns = Columns(bins, run.widths)
    margin = np.full(len(label), run.booster.base)
    while not run.done:
        grad, hess = gradients(margin, label)
        on, rows, grown = sampled(s, len(run.booster.trees), ids), at_root(len(label)), False
        while not grown:
            growth = run.growth
            grown = run.take(cell_sums(columns, rows, run.asks(), on, grad, hess))
            rows = moved(growth.tree, bins, rows)
        margin += tree_values(growth.tree, rows, len(margin))
    return run.booster


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _block(batches):
    """The rows (customer_id, label, bins) of a partition: (ids, labels, bins), or None where it has none."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    t = pa.Table.from_batches(held)
    return t.column(0).to_numpy(), t.column(1).to_numpy().astype(float), _matrix(t.column(2), t.num_rows)


def _fit_blocks(rows: DataFrame, presets: dict[str, BoostSettings], sizes: dict[int, int],
                n_features: int) -> dict[tuple[str, int], Booster]:
    """Runs whose rows are one block each: a job of one task a run, all side by side."""
    def fit_one(key):
        def run(batches, s=presets[key[0]]):
            ids, label, bins = block_of(batches, sizes[key[1]], n_features)
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(boost_block(s, ids, label, bins.T).slim())]})
        own = rows.where(F.col("fit") == key[1]).select("customer_id", "label", "bins").coalesce(1)
        return pickle.loads(own.mapInArrow(run, "model binary").collect()[0]["model"])

    keys = [(name, fit) for name in presets for fit in sizes]
    with ThreadPoolExecutor(len(keys)) as pool:
        return dict(zip(keys, pool.map(fit_one, keys)))


def _packed(batches):
    """The rows of a partition as one block: (ids, labels, bins by feature)."""
    block = _block(batches)
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": [pickle.dumps((*block[:2], np.ascontiguousarray(block[2].T)))]})


def _counted(at: int, s: BoostSettings, round_no: int, tree: Tree, nodes: list[int]):
    """A block with its margins -> (at, the sums of ``nodes``)."""
    def run(held):
        (ids, label, columns), margin = held
        grad, hess = gradients(margin, label)
        rows = moved(tree, columns.bins, at_root(len(ids)))
        return at, cell_sums(columns, rows, nodes, sampled(s, round_no, ids), grad, hess)
    return run


def _added(tree: Tree):
    """A block with its margins -> the same after one more tree."""
    def run(held):
        block, margin = held
        return block, margin + tree_values(tree, moved(tree, block[2].bins, at_root(len(margin))), len(margin))
    return run


def _slim(tree: Tree) -> Tree:
    return replace(tree, sums=[], level=[])


def _fit_steps(rows: DataFrame, presets: dict[str, BoostSettings], sizes: dict[int, tuple[int, int]]) -> dict[tuple[str, int], Booster]:
    """All runs together, one job a step."""
    sc = rows.sparkSession.sparkContext
    shared_dir(rows.sparkSession)  # margins are checkpointed there
    blocks, keys = {}, [(name, fit) for fit in sizes for name in presets]
    for fit, (n, _) in sizes.items():
        parts = max(1, -(-n // STEP_ROWS), sc.defaultParallelism // len(keys))
        blocks[fit] = rows.where(F.col("fit") == fit).select("customer_id", "label", "bins").repartition(parts) \
            .mapInArrow(_packed, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist()
    runs, states = [], []
    for name, fit in keys:
        base = log_odds(*sizes[fit])
        most = np.max(blocks[fit].map(lambda b: b[2].max(axis=1)).collect(), axis=0)
        widths = _widths(most)
        runs.append(Run(Booster(presets[name], base), widths))
        states.append(blocks[fit].map(lambda b, base=base, widths=widths: (
            (*b[:2], Columns(b[2], widths)), np.full(len(b[0]), base))).persist())
    old = []
    while True:
        waiting = [i for i, run in enumerate(runs) if not run.done]
        if not waiting:
            break
        asked = {i: runs[i].asks() for i in waiting}
        counted = sc.union([states[i].map(_counted(
            i, runs[i].booster.settings, len(runs[i].booster.trees), _slim(runs[i].growth.tree), asked[i]))
            for i in waiting])
        parts = counted.getNumPartitions()
        if parts > FEW_BLOCKS:
            counted = counted.reduceByKey(np.add, min(FEW_BLOCKS, math.isqrt(parts)))
        sums: dict[int, np.ndarray] = {}
        for i, cells in counted.collect():
            sums[i] = sums[i] + cells if i in sums else cells
        for state in old:  # replaced by margins that this job has worked out
            state.unpersist()
        old = []
        for i in waiting:
            if runs[i].take(sums[i]):
                old.append(states[i])
                made = runs[i].booster.trees
                if not runs[i].done:
                    states[i] = states[i].map(_added(_slim(made[-1]))).persist()
                    if len(made) % WRITE_EVERY == 0:
                        states[i].checkpoint()
    for state in [*old, *blocks.values()]:
        state.unpersist()
    return {key: run.booster.slim() for key, run in zip(keys, runs)}


def fit_boosters(binned: DataFrame, n_features: int, presets: dict[str, BoostSettings],
                 block_rows: int = BLOCK_ROWS) -> dict[tuple[str, int], Booster]:
    """{(preset, fit): booster} from the training rows of ``binned`` (fit, train, customer_id, label, bins).

    ``binned`` should be a written table with one row per (fit, customer_id).
    Both ways of running give the same trees.
    """
    rows = binned.where("train").select(F.col("fit").cast("int"), "customer_id", F.col("label").cast("long").alias("label"), "bins")
    sizes = {r["fit"]: (r["n"], r["p"]) for r in rows.groupBy("fit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    if not sizes:
        raise ValueError("no labelled rows to learn from")
    if max(n for n, _ in sizes.values()) <= block_rows:
        return _fit_blocks(rows, presets, {fit: n for fit, (n, _) in sizes.items()}, n_features)
    return _fit_steps(rows, presets, sizes)


def predict_boosters(boosters: dict[tuple[str, int], Booster], binned: DataFrame, *keep: str) -> DataFrame:
    """(preset, fit, *keep, score): every row of ``binned`` scored by the runs of its fit."""
    shared = binned.sparkSession.sparkContext.broadcast(boosters)

    def run(batches):
        for b in batches:
            fits, bins = b.column(0).to_numpy(), _matrix(b.column(b.num_columns - 1), b.num_rows)
            for (name, fit), booster in shared.value.items():
                own = np.flatnonzero(fits == fit)
                if not len(own):
                    continue
                score = 1 / (1 + np.exp(-booster.margins(bins[own])))
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own)), *[c.take(at) for c in b.columns[:-1]], pa.array(score)],
                    ["preset", "fit", *keep, "score"])
    rows = binned.select(F.col("fit").cast("int"), *keep, "bins")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1])
    return rows.mapInArrow(run, f"preset string, fit int, {kinds}, score double")
