"""Exact k nearest neighbours over all labelled rows, by pivots and ball bounds.

Training rows go to the cell of their nearest pivot (pivots are a bounded set
of training rows, by hash), and a cell's radius is its largest distance to
the pivot. A row is first compared with the nearest cells that together hold
k rows; the k-th distance found bounds it, and by the triangle inequality
only cells with d(row, pivot) - radius within that bound can hold anything
nearer, and of these only such whose half of the space, cut half way between
their pivot and the one nearest to the row, comes within it. The second pass compares it with these. Cells meet their rows in
blocks of bounded size, each block returns at most k rows for a row, and
nothing is broadcast but the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.operators.blocks import host_guest_blocks, runs
from churnlake.operators.prefix import materialize

NEIGHBOURS = 25
MOST_PIVOTS = 1024
#: Training rows a pivot stands for, as far as MOST_PIVOTS allows.
ROWS_A_PIVOT = 500
BLOCK = 4096
#: Rows that meet all pivots at once, and rows of a batch that goes on: a task holds some 20 MB of each kind.
ROWS_AT_ONCE = 512
ROWS_OUT = 16_384
#: Slack of the bounds for rounding, and what rounding to 9 decimals may add to a squared distance.
SLACK = 1e-6
ROUNDING = 2e-9


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b)."""
    d2 = a @ b.T
    d2 *= -2
    d2 += (a * a).sum(axis=1)[:, None]
    d2 += (b * b).sum(axis=1)[None, :]
    return d2


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b), to 9 decimals."""
    return np.round(np.maximum(_squared(a, b), 0), 9)


def nearest_in(a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance to 9 decimals) of the k nearest within each row's bound; ties to the first.

    Only what can be among them is rounded and sorted.
    """
    d2 = _squared(a, b)
    most = (bound + SLACK) ** 2 + ROUNDING
    if len(b) > k:
        open_ = np.flatnonzero((d2 <= most[:, None]).sum(axis=1) > k)
        if len(open_):
            most[open_] = np.minimum(most[open_], np.partition(d2[open_], k - 1, axis=1)[:, k - 1] + ROUNDING)
    row, col = np.nonzero(d2 <= most[:, None])
    near = np.round(np.maximum(d2[row, col], 0), 9)
    order = np.lexsort((col, near, row))
    row, col, near = row[order], col[order], near[order]
    keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (near <= (bound[row] + SLACK) ** 2)
    return row[keep], col[keep], near[keep]


def choose_pivots(rows: DataFrame, most: int = MOST_PIVOTS, share: int = ROWS_A_PIVOT) -> dict[int, np.ndarray]:
    """{fit: pivots}: about one training row in ``share``, those of the smallest hash, at most ``most``."""
    train = rows.where("train")
    sizes = {r["fit"]: r["count"] for r in train.groupBy("fit").count().collect()}
    h = F.xxhash64(F.lit("pivot"), "customer_id")
    few = train.select("fit", "x", h.alias("h"), F.row_number().over(Window.partitionBy("fit").orderBy(h)).alias("nth")) \
        .where(F.col("nth") <= most).orderBy("fit", "nth").collect()
    out: dict[int, list] = {}
    for r in few:
        if r["nth"] <= max(1, -(-sizes[r["fit"]] // share)):
            out.setdefault(r["fit"], []).append(r["x"])
    return {f: np.array(v) for f, v in out.items()}


def _small(batches):
    for b in batches:
        for lo in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(lo, ROWS_AT_ONCE)


def _celled(pivots: dict[int, np.ndarray]):
    """Batches of (fit, customer_id, label, x) -> the same with cell and r, the distance to its pivot."""
    def run(batches):
        for b in _small(batches):
            fits, x = b.column(0).to_numpy(), _matrix(b.column(3), b.num_rows)
            cell, r = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for f, p in pivots.items():
                own = np.flatnonzero(fits == f)
                d2 = squared_distances(x[own], p)
                cell[own], r[own] = d2.argmin(axis=1), np.sqrt(d2.min(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r)],
                                             ["fit", "customer_id", "label", "x", "cell", "r"])
    return run


def _visits(pivots, held: dict[tuple[int, int], tuple[int, float]], k: int, second: bool):
    """Batches of (fit, customer_id, label, x, bound) -> one row per cell to compare with.

    First the nearest cells that hold k rows; ``second``: the others within
    the bound.
    """
    apart = {f: np.sqrt(squared_distances(p, p)) for f, p in pivots.items()}

    def run(batches):
        for b in _small(batches):
            fits, x, bound = b.column(0).to_numpy(), _matrix(b.column(3), b.num_rows), b.column(4).to_numpy()
            at, cells = [], []
            for f, p in pivots.items():
                own = np.flatnonzero(fits == f)
                d = np.sqrt(squared_distances(x[own], p))
                n = np.array([held.get((f, c), (0, 0.0))[0] for c in range(len(p))])
                radius = np.array([held.get((f, c), (0, 0.0))[1] for c in range(len(p))])
                order = np.argsort(d, axis=1, kind="stable")
                # a row of another cell lies beyond the plane half way between its pivot and the nearest one
                near, own_d = order[:, :1], np.take_along_axis(d, order[:, :1], axis=1)
                beyond = np.divide(d * d - own_d * own_d, 2 * apart[f][near[:, 0]], out=np.zeros_like(d),
                                   where=apart[f][near[:, 0]] > 0.01)  # nearer ones would make too much of rounding
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                pick = (~first & (np.maximum(d - radius, beyond) <= bound[own][:, None] + SLACK) if second else first) & (n > 0)
                row, cell = np.nonzero(pick)
                at.append(own[row])
                cells.append(cell)
            at = np.concatenate(at) if at else np.empty(0, np.int64)
            cells = np.concatenate(cells) if cells else np.empty(0, np.int64)
            for lo in range(0, len(at), ROWS_OUT):  # a row may go to every cell
                take = pa.array(at[lo: lo + ROWS_OUT])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in b.columns], pa.array(cells[lo: lo + ROWS_OUT].astype(np.int32))],
                    ["fit", "customer_id", "label", "x", "bound", "cell"])
    return run


def _nearest(k: int):
    """Sorted blocks (fit, cell, i, j, host, customer_id, label, x, bound) -> at most k rows (.., id, y, d2) for each guest."""
    def run(batches):
        for t in runs(batches, 4):
            host = t.column("host").to_numpy()
            if host.all() or not host.any():
                continue
            ids, labels, bound = (t.column(c).to_numpy() for c in ("customer_id", "label", "bound"))
            x = _matrix(t.column("x"), t.num_rows)
            h = np.flatnonzero(host)
            h = h[np.argsort(ids[h], kind="stable")]  # ties go to the smaller id
            guests, fit = np.flatnonzero(~host), t.column("fit")[0].as_py()
            for lo in range(0, len(guests), 512):
                g = guests[lo: lo + 512]
                row, col, near = nearest_in(x[g], x[h], k, bound[g])
                to = h[col]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(row), fit, np.int32)), pa.array(ids[g[row]]), pa.array(ids[to]),
                    pa.array(labels[to]), pa.array(near)], ["fit", "customer_id", "id", "y", "d2"])
    return run


def _pass(hosts: DataFrame, guests: DataFrame, k: int, block: int) -> DataFrame:
    key = ["fit", "cell"]
    rows = hosts.select(*key, F.lit(True).alias("host"), "customer_id", "label", "x", F.lit(0.0).alias("bound")).unionByName(
        guests.select(*key, F.lit(False).alias("host"), "customer_id", "label", "x", "bound"))
    sizes = hosts.groupBy(*key).agg(F.count(F.lit(1)).alias("hosts")).join(
        guests.groupBy(*key).agg(F.count(F.lit(1)).alias("guests")), key)
    return host_guest_blocks(rows, sizes, key, block, "customer_id").mapInArrow(
        _nearest(k), "fit int, customer_id long, id long, y double, d2 double")


def nearest_rows(vectors: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK,
                 pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(fit, customer_id, id, y, d2): the k nearest training rows of every row that doesn't train, ties to the smaller id.

    ``vectors`` is a written table (fit, train, customer_id, label, x) with one row per (fit, customer_id).
    """
    rows = vectors.select(F.col("fit").cast("int").alias("fit"), "train", "customer_id",
                          F.col("label").cast("double").alias("label"), "x")
    pivots = choose_pivots(rows) if pivots is None else pivots
    hosts = materialize(rows.where("train").drop("train").mapInArrow(
        _celled(pivots), "fit int, customer_id long, label double, x array<double>, cell int, r double"))
    held = {(r["fit"], r["cell"]): (r["n"], r["radius"]) for r in hosts.groupBy("fit", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("r").alias("radius")).collect()}  # at most MOST_PIVOTS a fit
    schema = "fit int, customer_id long, label double, x array<double>, bound double, cell int"
    asked = rows.where("not train").drop("train")
    first = materialize(_pass(hosts, asked.withColumn("bound", F.lit(float("inf"))).mapInArrow(
        _visits(pivots, held, k, False), schema), k, block))
    best = Window.partitionBy("fit", "customer_id").orderBy("d2", "id")
    kept = first.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    bounds = kept.groupBy("fit", "customer_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf"))).alias("bound"))
    again = asked.join(bounds, ["fit", "customer_id"]).select("fit", "customer_id", "label", "x", "bound")
    second = _pass(hosts, again.mapInArrow(_visits(pivots, held, k, True), schema), k, block)
    both = materialize(kept.drop("nth").unionByName(second))
    return both.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")


def predict_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    """(fit, customer_id, label, score): labels of the k nearest weighted by 1 / distance; exact matches take all weight."""
    near = nearest_rows(vectors, k, **options)
    exact = F.col("d2") == 0
    score = F.when(F.min("d2") == 0, F.avg(F.when(exact, F.col("y")))).otherwise(
        F.sum(F.when(~exact, F.col("y") / F.sqrt("d2"))) / F.sum(F.when(~exact, 1 / F.sqrt("d2"))))
    scored = near.groupBy("fit", "customer_id").agg(score.alias("score"))
    asked = vectors.where("not train").select(F.col("fit").cast("int").alias("fit"), "customer_id", "label")
    return asked.join(scored, ["fit", "customer_id"], "left")
