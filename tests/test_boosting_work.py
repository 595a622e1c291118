"""Work of a boosting step and of scoring: columns added up together, trees that a replaced column doesn't touch."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np

from churnlake.operators import boosting as G


def _block(n, widths, seed=1):
    rng = np.random.default_rng(seed)
    return np.array([rng.integers(0, w, n) for w in widths], np.int8)


def test_joined_columns_give_each_columns_sums(monkeypatch):
    widths = [32, 32, 19, 31, 7, *[2] * 12, 1]
    bins = _block(3000, widths)
    rng = np.random.default_rng(2)
    grad = rng.integers(-(1 << 20), 1 << 20, 3000).astype(float)
    hess = np.full(3000, float(1 << 18))  # the largest there is
    on = rng.random(3000) < 0.7
    columns = G.Columns(bins, widths)
    assert sorted(f for own, _ in columns.joined for f in own) == list(range(len(widths)))
    assert len(columns.joined) <= 5 and all(number.max() < G.JOINED_CELLS for _, number in columns.joined)
    at = rng.integers(0, 3, 3000)
    rows = {n: np.flatnonzero(at == n) for n in range(3)}
    for packed in (1 << 16, 700):
        monkeypatch.setattr(G, "ROWS_PACKED", packed)
        got = G.cell_sums(columns, rows, [2, 0], on, grad, hess)
        for k, node in enumerate([2, 0]):
            cell = 0
            for f, w in enumerate(widths):
                for b in range(w):
                    own = (at == node) & on & (bins[f] == b)
                    assert got[k, cell].tolist() == [grad[own].sum(), hess[own].sum(), own.sum()]
                    cell += 1


def test_packed_sums_are_whole_at_their_largest():
    n = 2 * G.ROWS_PACKED + 5
    columns = G.Columns(np.zeros((1, n), np.int8), [1])
    hess = np.full(n, float(1 << 18))
    got = G.cell_sums(columns, G.at_root(n), [0], np.ones(n, bool), -hess, hess)
    assert got.tolist() == [[[-n * 2.0 ** 18, n * 2.0 ** 18, n]]]


def test_a_replaced_column_is_scored_by_the_trees_that_cut_it(monkeypatch):
    r = random.Random(4)
    x = np.array([[r.randrange(8) for _ in range(6)] for _ in range(400)])
    y = np.array([float((a[0] > 3) ^ (a[1] > 5) ^ (r.random() < 0.2)) for a in x])
    scorer = G.Scorer(G.boost_block(G.BoostSettings(rounds=12, leaves=3, min_rows=8, bins=8), np.arange(400), y, x))
    donor = x[::-1].copy()
    groups = {"a": [0], "b": [1, 2], "c": [3], "d": [4, 5]}
    routed, move = [], G.moved
    monkeypatch.setattr(G, "moved", lambda *v: routed.append(1) or move(*v))
    got = dict(scorer.replaced(x, donor, groups))
    cut = sum(not set(p).isdisjoint(t.feature) for t in scorer.booster.trees for p in groups.values())
    assert len(routed) == 12 + cut < 12 * 5
    for name, places in groups.items():
        mixed = x.copy()
        mixed[:, places] = donor[:, places]
        assert (got[name] == scorer(mixed)).all()  # to the last bit


def test_a_block_takes_few_bytes_a_row():
    n, rng = 200_000, np.random.default_rng(2)
    bins = np.vstack([rng.integers(0, 32, (14, n)), rng.integers(0, 2, (17, n))]).astype(np.int8)
    label = (bins[0] > 20).astype(np.int8)
    for settings in (G.PRESETS["gbt_xgb"], G.PRESETS["gbt_catboost"]):
        tracemalloc.start()
        G.boost_block(replace(settings, rounds=2), np.arange(n), label, bins.T)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 86 * n  # besides bins, labels and ids, which are 40 bytes a row
    assert 3_240_000 <= G.BLOCK_ROWS <= 600e6 / 140  # two tasks of an executor beside its heap
