"""Trees, boosting, neighbours, preparation and target statistics against plain versions."""

import random

import numpy as np
import pytest

from churnlake.operators import binning as B
from churnlake.operators import boosting as G
from churnlake.operators import forest as T
from churnlake.operators import logistic as R
from churnlake.operators import neighbours as N
from churnlake.operators import target_statistics as O

SCHEMA = "fit int, train boolean, customer_id long, label int, bins array<tinyint>"


def binned_rows(n=300, features=5, bins=8, fits=(0,), seed=1):
    r = random.Random(seed)
    out = []
    for f in fits:
        for i in range(n):
            b = [r.randrange(bins) for _ in range(features)]
            y = int((b[0] > 3) ^ (b[1] > 5) if r.random() < 0.8 else r.random() < 0.5)
            out.append((f, i % 5 != f % 5, i * 7, y, b))
    return out


def arrays(rows, fit=0, train=True):
    own = sorted((r for r in rows if r[0] == fit and r[1] == train), key=lambda r: r[2])
    return np.array([r[2] for r in own]), np.array([r[3] for r in own], float), np.array([r[4] for r in own])


# --- forest ---------------------------------------------------------------------


def slow_tree(s, ids, y, x, tree):
    """{heap number: (feature, cut, n, p)} of one tree, node by node."""
    w = T.draws(s, ids)[:, tree]
    forest, out = T.Forest(s, x.shape[1], [0]), {}

    def grow(node, rows, depth):
        n, p = int(w[rows].sum()), int((w[rows] * y[rows]).sum())
        out[node] = (-1, 0, n, p)
        if depth == s.max_depth or n < max(2, 2 * s.min_leaf) or p in (0, n):
            return
        best = None
        for f in forest.looked_at(np.array([tree]), np.array([node]))[0].tolist():
            held = sorted({int(v) for v, k in zip(x[rows, f], w[rows]) if k})
            cuts = held[:-1]
            if s.random_cut and len(held) > 1:
                h = int(T.mix(T.mix(T.mix(s.seed + 2, 1 + tree), node), f))
                cuts = [held[0] + h % (held[-1] - held[0])]
            for c in cuts:
                low = rows[x[rows, f] <= c]
                nl, pl = int(w[low].sum()), int((w[low] * y[low]).sum())
                if min(nl, n - nl) >= max(1, s.min_leaf):
                    score = (pl * pl + (nl - pl) ** 2) / nl + ((p - pl) ** 2 + (n - nl - p + pl) ** 2) / (n - nl)
                    if best is None or score > best[0]:
                        best = (score, f, c)
        if best:
            _, f, c = best
            out[node] = (f, c, n, p)
            grow(2 * node + 1, rows[x[rows, f] <= c], depth + 1)
            grow(2 * node + 2, rows[x[rows, f] > c], depth + 1)

    grow(0, np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("settings", [
    T.TreeSettings(trees=1, max_depth=4, min_leaf=5, bins=8),
    T.TreeSettings(trees=4, max_depth=5, min_leaf=2, features=2, bootstrap=True, bins=8),
    T.TreeSettings(trees=4, max_depth=5, min_leaf=2, features=3, random_cut=True, bins=8)])
def test_forest_grows_the_same_trees_as_a_plain_version_in_every_fit(spark, settings):
    rows = binned_rows(fits=(0, 1))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    forest = T.fit_forest(frame, 5, settings, [0, 1])
    for place, fit in enumerate((0, 1)):
        ids, y, x = arrays(rows, fit)
        for t in range(settings.trees):
            tree = place * settings.trees + t
            got = {i: (f, c, n, p) for g, i, f, c, n, p in forest.nodes() if g == tree}
            assert got == {i: v for i, v in slow_tree(settings, ids, y, x, t).items() if v[2]}
    scored = T.predict_forest(forest, frame.where("not train"), "customer_id").collect()
    assert len(scored) == 120 and all(0 <= r.score <= 1 for r in scored)


# --- boosting -------------------------------------------------------------------


def slow_boost(s, ids, y, x):
    """Margins after all rounds: best leaf first, one leaf at a time."""
    margin = np.full(len(y), G.log_odds(len(y), int(y.sum())))
    leaves_of = []
    for t in range(s.rounds):
        g, h = G.gradients(margin, y)
        on, columns = G.sampled(s, t, ids), G.columns_of(s, t, x.shape[1])

        def best(rows):
            rows, found = rows[on[rows]], None

            def part(r):
                hh = h[r].sum() / G.UNIT + s.l2
                return (g[r].sum() / G.UNIT) ** 2 / hh if hh > 0 else 0.0
            for f in np.flatnonzero(columns):
                for c in range(s.bins - 1):
                    low, high = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(low), len(high)) >= max(1, s.min_rows) and \
                            min(h[low].sum(), h[high].sum()) >= s.min_hessian * G.UNIT:
                        gain = part(low) + part(high) - part(rows)
                        if found is None or gain > found[0]:
                            found = (gain, f, c)
            return found if found and found[0] > 1e-9 else None

        leaves = [(0, np.arange(len(y)), 0)]  # age, rows, level
        age = 1
        while s.leaves is None or len(leaves) < s.leaves:
            able = [(b[0], -a, i, b) for i, (a, r, lv) in enumerate(leaves)
                    if (s.depth is None or lv < s.depth) and (b := best(r))]
            if not able:
                break
            _, _, i, (_, f, c) = max(able, key=lambda v: v[:2])
            _, rows, lv = leaves.pop(i)
            leaves += [(age, rows[x[rows, f] <= c], lv + 1), (age + 1, rows[x[rows, f] > c], lv + 1)]
            age += 2
        leaves_of.append(len(leaves))
        for _, rows, _ in leaves:
            own = rows[on[rows]]
            hh = h[own].sum() / G.UNIT + s.l2
            margin[rows] += -s.rate * (g[own].sum() / G.UNIT) / hh if hh > 0 else 0.0
    return margin, leaves_of


def slow_symmetric(s, y, x):
    margin = np.full(len(y), G.log_odds(len(y), int(y.sum())))
    for _ in range(s.rounds):
        g, h = G.gradients(margin, y)
        leaf = np.zeros(len(y), int)
        for _ in range(s.depth):
            def gain(f, c):
                total, ok = 0.0, False
                for v in np.unique(leaf):
                    r = np.flatnonzero(leaf == v)
                    low, high = r[x[r, f] <= c], r[x[r, f] > c]
                    if min(len(low), len(high)) < 1 or min(h[low].sum(), h[high].sum()) < s.min_hessian * G.UNIT:
                        continue
                    q = lambda k: (g[k].sum() / G.UNIT) ** 2 / (h[k].sum() / G.UNIT + s.l2)
                    total, ok = total + q(low) + q(high) - q(r), True
                return total if ok else -np.inf
            scored = [(gain(f, c), -f, -c) for f in range(x.shape[1]) for c in range(s.bins - 1)]
            best = max(scored)
            if best[0] <= 1e-9:
                break
            leaf = 2 * leaf + (x[:, -best[1]] > -best[2])
        for v in np.unique(leaf):
            r = leaf == v
            margin[r] += -s.rate * (g[r].sum() / G.UNIT) / (h[r].sum() / G.UNIT + s.l2)
    return margin


LEAFWISE = G.BoostSettings(rounds=4, rate=0.3, leaves=6, min_rows=8, l2=1.0, bins=8)
BY_DEPTH = G.BoostSettings(rounds=3, rate=0.3, leaves=None, depth=3, min_rows=1, min_hessian=3.0, row_share=0.8,
                           column_share=0.6, bins=8)
SYMMETRIC = G.BoostSettings(rounds=3, rate=0.3, leaves=None, depth=3, symmetric=True, min_rows=1, l2=3.0, bins=8)


@pytest.mark.parametrize("settings", [LEAFWISE, BY_DEPTH])
def test_boosting_equals_a_plain_version(settings):
    ids, y, x = arrays(binned_rows())
    booster = G.boost_block(settings, ids, y, x)
    want, leaves = slow_boost(settings, ids, y, x)
    assert np.allclose(booster.margins(x), want, atol=1e-12)
    reached = [len(np.unique(t.route(np.array(np.meshgrid(*[range(8)] * 5)).reshape(5, -1).T))) for t in booster.trees]
    assert reached == leaves and max(leaves) <= (settings.leaves or 8)


def test_symmetric_trees_equal_a_plain_version():
    ids, y, x = arrays(binned_rows())
    booster = G.boost_block(SYMMETRIC, ids, y, x)
    assert np.allclose(booster.margins(x), slow_symmetric(SYMMETRIC, y, x), atol=1e-12)
    for t in booster.trees:  # one cut a level
        by_level = {}
        for f, c, lv in zip(t.feature, t.cut, t.level):
            if f >= 0:
                by_level.setdefault(lv, set()).add((f, c))
        assert all(len(v) == 1 for v in by_level.values())


def test_one_job_a_step_gives_the_same_boosters(spark, monkeypatch):
    rows = binned_rows(fits=(0, 1))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    presets = {"a": LEAFWISE, "b": BY_DEPTH, "c": SYMMETRIC}
    monkeypatch.setattr(G, "WRITE_EVERY", 2)
    blocks, steps = G.fit_boosters(frame, 5, presets), G.fit_boosters(frame, 5, presets, block_rows=0)
    assert blocks == steps and set(blocks) == {(n, f) for n in presets for f in (0, 1)}
    ids, y, x = arrays(rows, 1)
    assert blocks["a", 1] == G.boost_block(LEAFWISE, ids, y, x).slim()
    scored = G.predict_boosters(blocks, frame.where("not train"), "customer_id").collect()
    assert len(scored) == 3 * 120


def test_a_step_measures_the_smaller_child(spark, monkeypatch):
    rows = binned_rows()
    ids, y, x = arrays(rows)
    seen, measure = [], G.cell_sums

    def counting(bins, node, nodes, *rest):
        out = measure(bins, node, nodes, *rest)
        seen.append((nodes, out[..., 2].sum()))
        return out
    monkeypatch.setattr(G, "cell_sums", counting)
    want = G.boost_block(LEAFWISE, ids, y, x).slim()
    # of two children one is measured, with at most half of the rows
    assert all(n == [0] or k <= len(y) * x.shape[1] / 2 for n, k in seen)
    monkeypatch.setattr(G, "cell_sums", measure)
    monkeypatch.setattr(G, "STEP_ROWS", 50)
    monkeypatch.setattr(G, "WRITE_EVERY", 2)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert G.fit_boosters(frame, 5, {"a": LEAFWISE}, block_rows=0)["a", 0] == want
    monkeypatch.setattr(G, "FEW_BLOCKS", 2)  # sums of many blocks are added up in tasks
    assert G.fit_boosters(frame, 5, {"a": LEAFWISE}, block_rows=0)["a", 0] == want


def test_boosting_of_no_rows_and_one_label(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        G.fit_boosters(empty, 5, {"a": LEAFWISE})
    booster = G.boost_block(LEAFWISE, np.arange(40), np.ones(40), np.zeros((40, 2), int))
    assert (booster.margins(np.zeros((1, 2), int)) > 10).all()


# --- preparation, logistic, neighbours ------------------------------------------

COLUMNS = "customer_id long, label int, fold int, a double, b double, c string"


def raw_rows(n=211, seed=3):
    r = random.Random(seed)
    return [(i, r.randrange(2), i % 3, r.choice([None, 1.0, 2.5, r.random() * 9]), float(r.randrange(4)),
             r.choice([None, "x", "y", "z"])) for i in range(n)]


def test_preparation_of_folds_equals_one_fit_each(spark):
    rows = raw_rows()
    folds = B.fold_fits(spark.createDataFrame(rows, COLUMNS), 3)
    prep = B.fit_preparation(folds, 8, ["a", "b"], ["c"])
    binned = {(r.fit, r.customer_id): r.bins for r in prep.binned(folds, "fit", "customer_id").collect()}
    vectors = {(r.fit, r.customer_id): r.x for r in prep.vectors(folds, "fit", "customer_id").collect()}
    for f in range(3):
        train = [r for r in rows if r[2] != f]
        for at, c in ((3, "a"), (4, "b")):
            known = [r[at] for r in train if r[at] is not None]
            assert prep.medians[f][c] == np.median(known)
            full = sorted(prep.medians[f][c] if r[at] is None else r[at] for r in train)
            cuts = sorted({full[-(-k * len(full) // 8) - 1] for k in range(1, 8)})
            assert prep.cuts[f][c] == cuts
            for r in rows:
                v = prep.medians[f][c] if r[at] is None else r[at]
                assert binned[f, r[0]][at - 3] == sum(x < v for x in cuts)
                assert vectors[f, r[0]][at - 3] == pytest.approx((v - np.mean(full)) / np.std(full))
    assert prep.names == ["a", "b", "c=x", "c=y", "c=z"] and prep.groups() == {"a": [0], "b": [1], "c": [2, 3, 4]}


def vector_rows(n=160, width=3, fits=(0,), seed=5):
    r = random.Random(seed)
    return [(f, i % 4 != 0, i, r.randrange(2), [round(r.random(), 1) for _ in range(width)]) for f in fits for i in range(n)]


VECTORS = "fit int, train boolean, customer_id long, label int, x array<double>"


def test_logistic_solves_each_fit(spark):
    rows = vector_rows(fits=(0, 1)) + [(1, True, 999, 1, [5.0, -5.0, 0.0])]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    beta = R.fit_logistic(frame, [0, 1], 3)
    for f in (0, 1):
        x = np.array([[*r[4], 1.0] for r in rows if r[0] == f and r[1]])
        y = np.array([r[3] for r in rows if r[0] == f and r[1]])
        p = 1 / (1 + np.exp(-x @ beta[f]))
        assert np.allclose(x.T @ (y - p) - np.append(beta[f][:-1], 0), 0, atol=1e-8)  # the penalised optimum
    scored = {(r.fit, r.customer_id): r.score for r in R.predict_logistic(beta, frame, "fit", "customer_id").collect()}
    assert scored[0, 4] == pytest.approx(float(1 / (1 + np.exp(-(np.append(rows[4][4], 1.0) @ beta[0])))))


@pytest.mark.parametrize("pivots,block,k", [(1, 4096, 5), (7, 10, 5), (20, 4096, 25), (3, 4096, 500)])
def test_neighbours_equal_brute_force(spark, pivots, block, k):
    rows = vector_rows(fits=(0, 1))
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    chosen = N.choose_pivots(frame, pivots, 1)
    assert all(len(p) == pivots for p in chosen.values())
    got = {}
    for r in N.nearest_rows(frame, k, block, chosen).collect():
        got.setdefault((r.fit, r.customer_id), []).append((r.d2, r.id))
    for f, train, i, _, x in rows:
        if not train:
            every = sorted((round(sum((a - b) ** 2 for a, b in zip(x, t[4])), 9), t[2]) for t in rows if t[0] == f and t[1])
            assert sorted(got[f, i]) == [pytest.approx(v) for v in every[:k]]


# --- target statistics -----------------------------------------------------------


def test_ordered_statistics_use_earlier_rows_only(spark):
    import hashlib
    rows = raw_rows() + [(9000 + i, i % 2, 0, 1.0, 1.0, "hot") for i in range(120)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {r.customer_id: r.statistic for r in O.ordered_statistics(frame, ["c"]).collect()}
    place = lambda i: (int(hashlib.md5(f"{O.SALT}{i}".encode()).hexdigest()[:8], 16), i)
    prior, seen = sum(r[1] for r in rows) / len(rows), {}
    for r in sorted(rows, key=lambda r: place(r[0])):
        s, n = seen.get(r[5], (0, 0))
        assert got[r[0]] == pytest.approx((s + prior) / (n + 1))
        seen[r[5]] = (s + r[1], n + 1)
    target = spark.createDataFrame([(1, "hot"), (2, None), (3, "new")], "customer_id long, c string")
    scored = {r.customer_id: r.statistic for r in O.scoring_statistics(frame, target, ["c"]).collect()}
    for i, c in ((1, "hot"), (2, None), (3, "new")):
        s, n = seen.get(c, (0, 0))
        assert scored[i] == pytest.approx((s + prior) / (n + 1))


def test_importance_of_a_model_equals_a_loop(spark):
    import hashlib
    from churnlake.operators.importance import model_importance
    rows = [(r[2], r[3], r[4]) for r in binned_rows(80)]
    score = G.Scorer(G.boost_block(LEAFWISE, *arrays(binned_rows(80))))
    frame = spark.createDataFrame(rows, "customer_id long, label int, bins array<tinyint>")
    groups = {"first": [0], "second": [1], "rest": [2, 3, 4]}
    got = {r.feature: (r.importance_mean, r.importance_std) for r in model_importance(frame, groups, score, 3).collect()}
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)

    def ap(y, s):
        cum = n = out = 0
        for v in sorted(set(s), reverse=True):
            t = [a for a, b in zip(y, s) if b == v]
            cum, n = cum + sum(t), n + len(t)
            out += sum(t) / sum(y) * cum / n
        return out
    base = sorted(rows, key=lambda r: (h(f"perm-base:42:{r[0]}"), r[0]))
    y, x = [r[1] for r in base], np.array([r[2] for r in base])
    for name, places in groups.items():
        drops = []
        for rep in range(3):
            donor = np.array([r[2] for r in sorted(rows, key=lambda r: (h(f"perm:42:{rep}:{r[0]}"), r[0]))])
            mixed = x.copy()
            mixed[:, places] = donor[:, places]
            drops.append(ap(y, score(x)) - ap(y, score(mixed)))
        assert got[name] == (pytest.approx(np.mean(drops)), pytest.approx(np.std(drops)))


def test_bucket_bounds_are_one_literal(spark):
    import time
    from churnlake.operators.prefix import bucket_expr
    bounds = [i / 40_001 for i in range(1, 40_001)]
    df = spark.range(5).selectExpr("CAST(id AS DOUBLE) / 5 AS x")
    t = time.time()
    q = df.select("x", bucket_expr("x", bounds, False).alias("b"), bucket_expr("x", bounds, True).alias("d"))
    q._jdf.queryExecution().executedPlan()
    assert time.time() - t < 5
    assert all(r.b == sum(v < r.x for v in bounds) and r.d == len(bounds) - r.b for r in q.collect())


# --- work that a task holds -------------------------------------------------------


def test_a_level_sends_each_cell_once_however_its_rows_are_batched(monkeypatch):
    rows = binned_rows(240)
    ids, y, x = arrays(rows)
    s = T.TreeSettings(trees=3, max_depth=3, min_leaf=2, features=2, bootstrap=True, bins=8)
    forest = T.Forest(s, 5, [0])
    tree, node = np.arange(3), np.zeros(3, np.int64)
    slot = np.full(forest.feature.shape, -1, np.int32)
    slot[tree, node] = tree
    looked = forest.looked_at(tree, node)

    class Shared:
        value = (forest, slot, looked)
    batches = [T.pa.RecordBatch.from_arrays(
        [T.pa.array(np.zeros(k, np.int32)), T.pa.array(ids[lo: lo + k]), T.pa.array(y[lo: lo + k].astype(np.int64)),
         T.pa.array(x[lo: lo + k].tolist(), T.pa.list_(T.pa.int8()))], ["fit", "customer_id", "label", "bins"])
        for lo in range(0, len(ids), 12) if (k := min(12, len(ids) - lo))]
    keys = [k for b in T._level_counts(Shared, 3)(batches) for k in b.column(0).to_pylist()]
    assert len(keys) == len(set(keys)) <= 3 * 2 * 8


def test_visits_go_on_in_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(N, "ROWS_OUT", 16)
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 8)
    rng = np.random.default_rng(5)
    x, pivots = rng.normal(size=(40, 3)), rng.normal(size=(9, 3))
    batch = N.pa.RecordBatch.from_arrays(
        [N.pa.array(np.zeros(40, np.int32)), N.pa.array(np.arange(40)), N.pa.array(np.zeros(40)),
         N.pa.array(x.tolist()), N.pa.array(np.full(40, np.inf))], ["fit", "customer_id", "label", "x", "bound"])
    held = {(0, c): (5, 9.0) for c in range(9)}
    out = list(N._visits({0: pivots}, held, 5, True)([batch]))
    assert max(b.num_rows for b in out) <= 16 and sum(b.num_rows for b in out) == 40 * 8  # all but the first cell of each


def test_cells_beyond_the_bound_are_left_out_and_no_neighbour_is_lost():
    rng = np.random.default_rng(6)
    x, pivots, hosts = rng.normal(size=(60, 4)), rng.normal(size=(12, 4)), rng.normal(size=(900, 4))
    cell = N.squared_distances(hosts, pivots).argmin(axis=1)
    away = np.sqrt(N.squared_distances(hosts, pivots).min(axis=1))
    held = {(0, c): (int((cell == c).sum()), float(away[cell == c].max(initial=0))) for c in range(12)}
    d = np.sqrt(N.squared_distances(x, hosts))
    bound = np.sort(d, axis=1)[:, 4]
    batch = N.pa.RecordBatch.from_arrays(
        [N.pa.array(np.zeros(60, np.int32)), N.pa.array(np.arange(60)), N.pa.array(np.zeros(60)),
         N.pa.array(x.tolist()), N.pa.array(bound)], ["fit", "customer_id", "label", "x", "bound"])
    seen = {(r["customer_id"], r["cell"]) for second in (False, True)
            for b in N._visits({0: pivots}, held, 5, second)([batch]) for r in b.to_pylist()}
    assert all((i, cell[h]) in seen for i, h in zip(*np.nonzero(d <= bound[:, None])))
    balls = np.sqrt(N.squared_distances(x, pivots)) - [held[0, c][1] for c in range(12)] <= bound[:, None]
    assert len(seen) < balls.sum()


# --- forests at size --------------------------------------------------------------


@pytest.mark.parametrize("settings", [
    T.TreeSettings(trees=5, max_depth=6, min_leaf=2, features=2, bootstrap=True, bins=8),
    T.TreeSettings(trees=5, max_depth=6, min_leaf=2, features=3, random_cut=True, bins=8)])
def test_a_block_and_levels_grow_the_same_forest(spark, monkeypatch, settings):
    frame = spark.createDataFrame(binned_rows(fits=(0, 1)), SCHEMA).repartition(3)
    blocks, levels = (T.fit_forest(frame, 5, settings, [0, 1], **o) for o in ({}, {"block_rows": 0}))
    assert blocks.nodes() == levels.nodes() and len(blocks.nodes()) > 50
    ids, y, x = arrays(binned_rows(fits=(0, 1)), 1)
    for alone, rows in ((1, 7), (40, 100_000)):  # nodes counted by themselves, in parts, or together
        monkeypatch.setattr(T, "ROWS_ALONE", alone)
        monkeypatch.setattr(T, "ROWS_COUNTED", rows)
        made = T.grow_tree(settings, 3, ids, y.astype(np.int8), np.ascontiguousarray(x.T.astype(np.int8)))
        got = T.Forest(settings, 5, [0])
        got.put(0, *made)
        assert [n[1:] for n in got.nodes()] == [n[1:] for n in blocks.nodes() if n[0] == 5 + 3]


@pytest.mark.parametrize("rows", [4_000_000, 0])
def test_a_forest_holds_the_nodes_that_there_are(spark, rows):
    settings = T.TreeSettings(trees=20, max_depth=12, min_leaf=5, features=3, bootstrap=True, bins=8)
    forest = T.fit_forest(spark.createDataFrame(binned_rows(), SCHEMA), 5, settings, [0], rows)
    assert forest.feature.shape[1] <= 2 * 240 // 5  # 8191 by heap number
    assert len(T.pickle.dumps(forest.routes())) < 50_000


# --- comparing rows ---------------------------------------------------------------


def test_nearest_rows_of_a_block_are_those_of_a_full_sort_with_ties_and_bounds():
    rng = np.random.default_rng(8)
    for k, hosts in ((5, 300), (25, 10)):
        a, b = rng.integers(0, 3, (40, 4)).astype(float), rng.integers(0, 3, (hosts, 4)).astype(float)
        a[0], b[7] = a[0] + 1e-11, b[3]  # the same to 9 decimals
        bound = np.where(np.arange(40) % 2, np.inf, 1.0)
        row, col, near = N.nearest_in(a, b, k, bound)
        d2 = N.squared_distances(a, b)
        want = [(i, j, d2[i, j]) for i in range(40) for j in np.argsort(d2[i], kind="stable")[:k]
                if d2[i, j] <= (bound[i] + N.SLACK) ** 2]
        assert list(zip(row.tolist(), col.tolist(), near.tolist())) == [tuple(w) for w in want]
