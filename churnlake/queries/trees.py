"""Tree learners on the exact split, each with an oracle that grows the same trees in SQL, level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import binning as B
from churnlake.operators import boosting as G
from churnlake.operators import forest as T
from churnlake.operators import logistic as R
from churnlake.operators import neighbours as N
from churnlake.operators import target_statistics as O
from churnlake.operators.learners import FORESTS
from churnlake.operators.prefix import materialize
from churnlake.oracle import CHAIN, sql
from churnlake.queries.common import mart_df
from churnlake.queries.learners import _SPLIT_ROWS, _exact
from churnlake.queries.metrics import _EXACT
from churnlake.registry import register, round_doubles
from churnlake.schemas import CATEGORICAL_FEATURES, CLASSIFICATION_THRESHOLD, NUMERIC_FEATURES, WATCHLIST_THRESHOLD

_N, _C, _K = len(NUMERIC_FEATURES), len(CATEGORICAL_FEATURES), B.BINS


def prepared_sql(fit: str = "split = 'train'") -> list[str]:
    """CTEs: im (imputed rows with split), nl (long numeric), cuts, cats, bl (long bins) of the rows that have a label."""
    names = "[" + ", ".join(f"'{c}'" for c in NUMERIC_FEATURES) + "]"
    cat_names = "[" + ", ".join(f"'{c}'" for c in CATEGORICAL_FEATURES) + "]"
    medians = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in NUMERIC_FEATURES)
    modes = ", ".join(f"(SELECT {c} FROM tm WHERE {fit} AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                      f" AS o_{c}" for c in CATEGORICAL_FEATURES)
    imputed = ", ".join([f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in NUMERIC_FEATURES]
                        + [f"coalesce({c}, o_{c}) AS {c}" for c in CATEGORICAL_FEATURES])
    return [_EXACT, _SPLIT_ROWS, "tm AS MATERIALIZED (SELECT m.*, es.split FROM mart m JOIN es USING (customer_id) "
            "WHERE m.churn_flag IS NOT NULL)",
            f"md AS MATERIALIZED (SELECT {medians} FROM tm WHERE {fit})", f"mo AS MATERIALIZED (SELECT {modes})",
            f"im AS MATERIALIZED (SELECT customer_id, churn_flag AS label, split, {imputed} FROM tm, md, mo)",
            f"nl AS MATERIALIZED (SELECT customer_id, label, split, list_position({names}, name) - 1 AS f, v FROM im "
            f"UNPIVOT (v FOR name IN ({', '.join(NUMERIC_FEATURES)})))",
            f"""cuts AS MATERIALIZED (SELECT DISTINCT f, v AS cut FROM (
  SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n FROM nl WHERE {fit})
  JOIN (SELECT unnest(range(1, {_K})) AS k) ON rn = (k * n + {_K - 1}) // {_K})""",
            f"cl AS MATERIALIZED (SELECT customer_id, label, split, list_position({cat_names}, name) AS ci, v FROM im "
            f"UNPIVOT (v FOR name IN ({', '.join(CATEGORICAL_FEATURES)})))",
            f"cats AS MATERIALIZED (SELECT ci, v, {_N - 1} + row_number() OVER (ORDER BY ci, v) AS f "
            f"FROM (SELECT DISTINCT ci, v FROM cl WHERE {fit}))",
            """bl AS MATERIALIZED (
  SELECT customer_id, label, split, nl.f, count(cut) AS bin FROM nl LEFT JOIN cuts ON cuts.f = nl.f AND cuts.cut < nl.v
  GROUP BY ALL
  UNION ALL
  SELECT customer_id, label, split, cats.f, CAST(cl.v = cats.v AS BIGINT) FROM cl JOIN cats ON cats.ci = cl.ci)"""]


def _mix(name: str, h, x) -> str:
    """Select items that end in ``name``: forest.mix(h, x)."""
    p = T.PRIME
    return (f"(CAST({h} AS BIGINT) * 1103515245 + CAST({x} AS BIGINT) % {p} * 12345 + 1013904223) % {p} AS {name}_1, "
            f"({name}_1 * 48271 + {name}_1 // 65536) % {p} AS {name}_2, "
            f"({name}_2 * 69621 + {name}_2 // 32768) % {p} AS {name}")


def forest_sql(s: T.TreeSettings, targets: str = "split = 'validation'") -> list[str]:
    """CTEs that end in sc (customer_id, label, score) and nd (tree, node, f, cut, n, p), grown on the train rows."""
    drawn = " + ".join(f"CAST(w >= {t} AS BIGINT)" for t in T.DRAWN) if s.bootstrap else "1"
    out = [f"tree_h AS (SELECT t AS tree, {_mix('th', s.seed, '1 + t')} FROM (SELECT unnest(range({s.trees})) AS t))",
           f"""a0 AS MATERIALIZED (SELECT customer_id, label, tree, CAST(0 AS BIGINT) AS node,
  CASE WHEN split = 'train' THEN {drawn} ELSE 0 END AS n, {targets} AS target
  FROM (SELECT im.customer_id, label, split, tree, {_mix('w', 'th', 'im.customer_id')} FROM im, tree_h)
  WHERE split = 'train' OR {targets})"""]
    score = "(pl * pl + (nl - pl) * (nl - pl)) / nl + ((p - pl) * (p - pl) + (n - nl - p + pl) * (n - nl - p + pl)) / (n - nl)"
    for d in range(s.max_depth):
        look = (f"(SELECT o.*, fs.f, {_mix('fa', s.seed + 1, '1 + o.tree')}, {_mix('fb', 'fa', 'o.node')}, {_mix('fh', 'fb', 'fs.f')} "
                f"FROM o{d} o, (SELECT DISTINCT f FROM bl) fs)")
        first = f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY fh, f) <= {s.features}" if s.features else ""
        out += [f"""st{d} AS MATERIALIZED (SELECT tree, node, sum(n) AS n, sum(n * label) AS p FROM a{d} GROUP BY tree, node)""",
                f"o{d} AS MATERIALIZED (SELECT * FROM st{d} WHERE n >= {max(2, 2 * s.min_leaf)} AND p > 0 AND p < n)",
                f"l{d} AS MATERIALIZED (SELECT tree, node, f, n, p FROM {look} {first})",
                f"""h{d} AS MATERIALIZED (SELECT l.tree, l.node, l.f, bl.bin, any_value(l.n) AS n, any_value(l.p) AS p, sum(a.n) AS bn,
  sum(a.n * a.label) AS bp FROM a{d} a JOIN l{d} l ON l.tree = a.tree AND l.node = a.node
  JOIN bl ON bl.customer_id = a.customer_id AND bl.f = l.f WHERE a.n > 0 GROUP BY l.tree, l.node, l.f, bl.bin)""",
                f"""c{d} AS MATERIALIZED (SELECT tree, node, f, bin, n, p, sum(bn) OVER upto AS nl, sum(bp) OVER upto AS pl,
  min(bin) OVER cell AS low, max(bin) OVER cell AS high, lead(bin) OVER (PARTITION BY tree, node, f ORDER BY bin) AS nxt
  FROM h{d} WINDOW cell AS (PARTITION BY tree, node, f),
  upto AS (PARTITION BY tree, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING))"""]
        cells = f"c{d}"
        if s.random_cut:
            out.append(f"""r{d} AS MATERIALIZED (SELECT tree, node, f, cut AS bin, n, p, nl, pl FROM (
  SELECT *, low + rh % (high - low) AS cut FROM (
    SELECT *, {_mix('ra', s.seed + 2, '1 + tree')}, {_mix('rb', 'ra', 'node')}, {_mix('rh', 'rb', 'f')} FROM c{d} WHERE high > low))
  WHERE bin <= cut AND nxt > cut)""")
            cells = f"r{d}"
        out += [f"""b{d} AS MATERIALIZED (SELECT tree, node, f, bin AS cut FROM {cells}
  WHERE nl >= {s.min_leaf} AND n - nl >= {s.min_leaf} AND nl < n
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {score} DESC, f, bin) = 1)""",
                f"""a{d + 1} AS MATERIALIZED (SELECT a.customer_id, a.label, a.tree, 2 * a.node + 1 + CAST(bl.bin > b.cut AS BIGINT) AS node,
  a.n, a.target FROM a{d} a JOIN b{d} b ON b.tree = a.tree AND b.node = a.node
  JOIN bl ON bl.customer_id = a.customer_id AND bl.f = b.f)"""]
    last = s.max_depth
    out += [f"st{last} AS MATERIALIZED (SELECT tree, node, sum(n) AS n, sum(n * label) AS p FROM a{last} GROUP BY tree, node)",
            f"b{last} AS MATERIALIZED (SELECT tree, node, f, cut FROM b{last - 1} WHERE false)"]
    ends = " UNION ALL ".join(
        f"SELECT a.customer_id, a.label, s.p / s.n AS v FROM a{d} a JOIN st{d} s ON s.tree = a.tree AND s.node = a.node "
        f"ANTI JOIN b{d} b ON b.tree = a.tree AND b.node = a.node WHERE a.target" for d in range(last + 1))
    nodes = " UNION ALL ".join(
        f"SELECT s.tree, s.node, b.f, b.cut, s.n, s.p FROM st{d} s LEFT JOIN b{d} b ON b.tree = s.tree AND b.node = s.node"
        for d in range(last + 1))
    out += [f"sc AS MATERIALIZED (SELECT customer_id, any_value(label) AS label, avg(v) AS score FROM ({ends}) GROUP BY customer_id)",
            f"nd AS MATERIALIZED ({nodes})"]
    return out


CART, FOREST, EXTRA = FORESTS["decision_tree"], FORESTS["random_forest"], FORESTS["extra_trees"]

SCORED = ("SELECT customer_id, CAST(label AS INTEGER) AS label, round(score, 6) AS score, "
          "CAST(score >= 0.5 AS INTEGER) AS prediction FROM sc")


def scored_rows(scored):
    """Validation rows as the oracle returns them."""
    return round_doubles(scored.select("customer_id", F.col("label").cast("int").alias("label"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("prediction")))


def prepared_split(spark, sf):
    """(preparation, rows of the train and validation splits as fit 0)."""
    rows = materialize(B.single_fit(_exact(spark, sf)).withColumnRenamed("churn_flag", "label"))
    return B.fit_preparation(rows), rows


def binned_split(spark, sf):
    """(preparation, written rows: customer_id, label, train, bins)."""
    prep, rows = prepared_split(spark, sf)
    return prep, materialize(prep.binned(rows, "fit", "train", "customer_id", "label"))


def _forest(spark, sf, settings):
    prep, rows = binned_split(spark, sf)
    forest = T.fit_forest(rows, len(prep.names), settings)
    return scored_rows(T.predict_forest(forest, rows.where("not train"), "customer_id", "label"))


@register("model_tree", sql(*CHAIN, *prepared_sql(), *forest_sql(CART), body=SCORED))
def model_tree(spark, sf):
    """Decision tree: depth 8, at least 20 rows a leaf."""
    return _forest(spark, sf, CART)


@register("model_tree_nodes", sql(*CHAIN, *prepared_sql(), *forest_sql(CART), body="""
SELECT node, CAST(coalesce(f, -1) AS BIGINT) AS feature, CAST(coalesce(cut, 0) AS BIGINT) AS cut, CAST(n AS BIGINT) AS train_rows,
  CAST(p AS BIGINT) AS positives FROM nd WHERE n > 0"""))
def model_tree_nodes(spark, sf):
    """Splits and leaves of the decision tree, by heap number; ``cut`` is the last bin that goes left."""
    prep, rows = binned_split(spark, sf)
    forest = T.fit_forest(rows, len(prep.names), CART)
    return spark.createDataFrame([n[1:] for n in forest.nodes()],
                                 "node long, feature long, cut long, train_rows long, positives long")


@register("model_forest", sql(*CHAIN, *prepared_sql(), *forest_sql(FOREST), body=SCORED))
def model_forest(spark, sf):
    """Random forest of 250 trees, at least 3 draws a leaf."""
    return _forest(spark, sf, FOREST)


@register("model_extra_trees", sql(*CHAIN, *prepared_sql(), *forest_sql(EXTRA), body=SCORED))
def model_extra_trees(spark, sf):
    """Extremely randomised forest of 250 trees: one cut for each feature that a node looks at."""
    return _forest(spark, sf, EXTRA)


# --- logistic regression --------------------------------------------------------


def vectors_sql() -> list[str]:
    """CTEs that end in xv (customer_id, y, split, x): scaled numbers, indicators, and 1 for the intercept."""
    return [f"mm AS MATERIALIZED (SELECT f, avg(v) AS mu, coalesce(nullif(stddev_pop(v), 0), 1.0) AS sd FROM nl "
           f"WHERE split = 'train' GROUP BY f)",
           """xl AS MATERIALIZED (
  SELECT customer_id, label, split, f, (v - mu) / sd AS v FROM nl JOIN mm USING (f)
  UNION ALL SELECT customer_id, label, split, f, CAST(bin AS DOUBLE) FROM bl WHERE f >= %d)""" % _N,
           """xv AS MATERIALIZED (SELECT customer_id, any_value(label) AS y, any_value(split) AS split,
  list_append(list(v ORDER BY f), 1.0::DOUBLE) AS x FROM xl GROUP BY customer_id)"""]


def logistic_sql(steps: int = 8) -> list[str]:
    """CTEs that end in co (coefficients as a list, intercept last) and sc: Newton steps with a list-wise elimination."""
    width = "(SELECT count(DISTINCT f) FROM bl)"
    out = [*vectors_sql(),
           f"co0 AS MATERIALIZED (SELECT [0.0::DOUBLE FOR i IN range({width} + 1)] AS b)"]
    # an augmented matrix is solved by Gauss-Jordan elimination: one list_reduce step a pivot
    pivot = "CAST(k[1][1] AS BIGINT)"
    row = f"m[{pivot}]"
    solve = (f"list_reduce([s] || [[[CAST(i AS DOUBLE)]] FOR i IN range(1, n + 1)], lambda m, k: "
             f"[CASE WHEN i = {pivot} THEN [v / {row}[{pivot}] FOR v IN m[i]] "
             f"ELSE [m[i][j] - m[i][{pivot}] * {row}[j] / {row}[{pivot}] FOR j IN range(1, n + 2)] END FOR i IN range(1, n + 1)])")
    for t in range(steps):
        out += [f"""pr{t} AS MATERIALIZED (SELECT x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xv, co{t} WHERE split = 'train')""",
                f"""gr{t} AS MATERIALIZED (SELECT i, sum(x[i] * (y - p)) AS g FROM pr{t}, (SELECT unnest(range(1, {width} + 2)) AS i) GROUP BY i)""",
                f"""he{t} AS MATERIALIZED (SELECT i, list(v ORDER BY j) AS r FROM (
  SELECT i, j, sum(x[i] * x[j] * p * (1 - p)) + CASE WHEN i = j THEN CASE WHEN i <= {width} THEN 1.0 ELSE 1e-12 END ELSE 0.0 END AS v
  FROM pr{t}, (SELECT unnest(range(1, {width} + 2)) AS i), (SELECT unnest(range(1, {width} + 2)) AS j) GROUP BY i, j) GROUP BY i)""",
                f"""au{t} AS MATERIALIZED (SELECT list(list_append(r, g - CASE WHEN i <= {width} THEN b[i] ELSE 0.0 END) ORDER BY i) AS s,
  CAST(count(*) AS BIGINT) AS n FROM he{t} JOIN gr{t} USING (i), co{t})""",
                f"""co{t + 1} AS MATERIALIZED (SELECT [b[i] + z[i][n + 1] FOR i IN range(1, n + 1)] AS b
  FROM (SELECT {solve} AS z, n FROM au{t}), co{t})"""]
    out += [f"co AS MATERIALIZED (SELECT b FROM co{steps})",
            "sc AS MATERIALIZED (SELECT customer_id, y AS label, 1 / (1 + exp(-list_dot_product(x, b))) AS score "
            "FROM xv, co WHERE split = 'validation')"]
    return out


def _vectors(spark, sf):
    prep, rows = prepared_split(spark, sf)
    return prep, materialize(prep.vectors(rows, "fit", "train", "customer_id", "label"))


@register("model_logistic", sql(*CHAIN, *prepared_sql(), *logistic_sql(), body=SCORED))
def model_logistic(spark, sf):
    """Logistic regression on scaled numbers and indicators, penalty C = 1."""
    prep, rows = _vectors(spark, sf)
    beta = R.fit_logistic(rows, prep.fits, len(prep.names))
    return scored_rows(R.predict_logistic(beta, rows.where("not train"), "customer_id", "label"))


@register("logistic_coefficients", sql(*CHAIN, *prepared_sql(), *logistic_sql(), body="""
SELECT CAST(i - 1 AS BIGINT) AS position, round(b[i], 6) AS coefficient FROM co, (SELECT unnest(range(1, len(b) + 1)) AS i FROM co)"""))
def logistic_coefficients(spark, sf):
    """Coefficients in the order of the features (numbers, then categories by name); the intercept is last."""
    prep, rows = _vectors(spark, sf)
    beta = R.fit_logistic(rows, prep.fits, len(prep.names))[0]
    return round_doubles(spark.createDataFrame(list(enumerate(beta.tolist())), "position long, coefficient double"))


# --- neighbours -------------------------------------------------------------------


@register("model_knn", sql(*CHAIN, *prepared_sql(), *vectors_sql(), """
dist AS (SELECT v.customer_id, v.y AS label, t.y, t.customer_id AS id, round(pow(list_distance(v.x, t.x), 2), 9) AS d2
  FROM xv v, xv t WHERE v.split = 'validation' AND t.split = 'train'),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d2, id) <= 25),
sc AS (SELECT customer_id, label, CASE WHEN min(d2) = 0 THEN avg(y) FILTER (WHERE d2 = 0)
    ELSE sum(y / sqrt(nullif(d2, 0))) / sum(1 / sqrt(nullif(d2, 0))) END AS score FROM near GROUP BY customer_id, label)""", body="""
SELECT customer_id, CAST(label AS INTEGER) AS label, round(score, 6) AS score,
  CAST(round(score, 9) > 0.5 AS INTEGER) AS prediction FROM sc"""))
def model_knn(spark, sf):
    """25 nearest of all training rows, weighted by distance, for every validation row."""
    _, rows = _vectors(spark, sf)
    scored = N.predict_neighbours(rows)
    return round_doubles(scored.select("customer_id", F.col("label").cast("int").alias("label"), "score",
                                       (F.round("score", 9) > 0.5).cast("int").alias("prediction")))


# --- boosting by levels -----------------------------------------------------------


def boost_sql(s: G.BoostSettings) -> list[str]:
    """CTEs that end in sc: ``s.rounds`` trees of ``s.depth`` levels, gradients in whole units."""
    u = repr(G.UNIT)
    side = lambda g, h: f"({g} / {u}) * ({g} / {u}) / ({h} / {u} + {s.l2})"
    gain = f"{side('gl', 'hl')} + {side('(g - gl)', '(h - hl)')} - {side('g', 'h')}"
    out = ["m0 AS MATERIALIZED (SELECT customer_id, label, split, ln(r / (1 - r)) AS m FROM im, "
           "(SELECT avg(label) AS r FROM im WHERE split = 'train') WHERE split IN ('train', 'validation'))"]
    for t in range(s.rounds):
        out.append(f"""a{t}_0 AS MATERIALIZED (SELECT customer_id, split = 'train' AS tr, CAST(0 AS BIGINT) AS node,
  CASE WHEN split = 'train' THEN round_even((p - label) * {u}, 0) ELSE 0 END AS g,
  CASE WHEN split = 'train' THEN round_even(p * (1 - p) * {u}, 0) ELSE 0 END AS h
  FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{t}))""")
        for d in range(s.depth):
            out += [f"""h{t}_{d} AS MATERIALIZED (SELECT node, f, bin, sum(g) AS bg, sum(h) AS bh, count(*) AS bn
  FROM a{t}_{d} a JOIN bl USING (customer_id) WHERE tr GROUP BY node, f, bin)""",
                    f"""c{t}_{d} AS MATERIALIZED (SELECT node, f, bin, sum(bg) OVER upto AS gl, sum(bh) OVER upto AS hl, sum(bn) OVER upto AS nl,
  sum(bg) OVER cell AS g, sum(bh) OVER cell AS h, sum(bn) OVER cell AS n FROM h{t}_{d}
  WINDOW cell AS (PARTITION BY node, f), upto AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING))""",
                    f"""b{t}_{d} AS MATERIALIZED (SELECT node, f, bin AS cut FROM (SELECT *, {gain} AS gain FROM c{t}_{d}
  WHERE nl >= {max(1, s.min_rows)} AND n - nl >= {max(1, s.min_rows)} AND hl >= {s.min_hessian} * {u} AND h - hl >= {s.min_hessian} * {u})
  WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)""",
                    f"""a{t}_{d + 1} AS MATERIALIZED (SELECT a.customer_id, a.tr, 2 * a.node + 1 + CAST(bl.bin > b.cut AS BIGINT) AS node, a.g, a.h
  FROM a{t}_{d} a JOIN b{t}_{d} b ON b.node = a.node JOIN bl ON bl.customer_id = a.customer_id AND bl.f = b.f)"""]
        ends = " UNION ALL ".join(
            f"SELECT a.customer_id, v.v FROM a{t}_{d} a JOIN (SELECT node, (-{s.rate} * (sum(g) / {u})) / (sum(h) / {u} + {s.l2}) AS v "
            f"FROM a{t}_{d} GROUP BY node) v ON v.node = a.node"
            + (f" ANTI JOIN b{t}_{d} b ON b.node = a.node" if d < s.depth else "") for d in range(s.depth + 1))
        out.append(f"m{t + 1} AS MATERIALIZED (SELECT m.customer_id, label, split, m + v AS m FROM m{t} m JOIN ({ends}) e USING (customer_id))")
    out.append(f"sc AS MATERIALIZED (SELECT customer_id, label, 1 / (1 + exp(-m)) AS score FROM m{s.rounds} WHERE split = 'validation')")
    return out


LEVELS = G.BoostSettings(rounds=6, rate=0.3, leaves=None, depth=3, min_rows=10, l2=1.0)


@register("model_gbt_levels", sql(*CHAIN, *prepared_sql(), *boost_sql(LEVELS), body=SCORED))
def model_gbt_levels(spark, sf):
    """Six boosting rounds of depth 3, one job a level: the way that boosting takes above a block of rows."""
    prep, rows = binned_split(spark, sf)
    made = G.fit_boosters(rows, len(prep.names), {"levels": LEVELS}, block_rows=0)
    return scored_rows(G.predict_boosters(made, rows.where("not train"), "customer_id", "label"))


# --- ordered target statistics ------------------------------------------------------

_H = "CAST(('0x' || substr(md5('target-statistics:' || CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT AS BIGINT)"
_CELLS = (f"tl AS (SELECT customer_id, churn_flag AS y, split, {_H} AS h, name AS column_name, category FROM tm "
          f"UNPIVOT INCLUDE NULLS (category FOR name IN ({', '.join(CATEGORICAL_FEATURES)})))")


@register("ordered_target_statistics", sql(*CHAIN, *prepared_sql()[:3], _CELLS, """
pri AS (SELECT avg(churn_flag) AS p FROM tm WHERE split = 'train'),
tr AS (SELECT customer_id, column_name, category, (coalesce(sum(y) OVER w, 0) + p) / (count(*) OVER w + 1) AS statistic
  FROM tl, pri WHERE split = 'train'
  WINDOW w AS (PARTITION BY column_name, category ORDER BY h, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kn AS (SELECT column_name, category, sum(y) AS s, count(*) AS n FROM tl WHERE split = 'train' GROUP BY ALL)""", body="""
SELECT 'train' AS split, customer_id, column_name, category, round(statistic, 6) AS statistic FROM tr
UNION ALL
SELECT 'validation', customer_id, t.column_name, t.category, round((coalesce(s, 0) + p) / (coalesce(n, 0) + 1), 6)
FROM tl t LEFT JOIN kn ON kn.column_name = t.column_name AND kn.category IS NOT DISTINCT FROM t.category, pri WHERE t.split = 'validation'"""))
def ordered_target_statistics(spark, sf):
    """Categories of the training rows as ordered statistics, of the validation rows as statistics of all training rows."""
    rows = materialize(_exact(spark, sf).withColumnRenamed("churn_flag", "label"))
    train, target = rows.where("split = 'train'"), rows.where("split = 'validation'")
    made = O.ordered_statistics(train, CATEGORICAL_FEATURES).withColumn("split", F.lit("train")).unionByName(
        O.scoring_statistics(train, target, CATEGORICAL_FEATURES).withColumn("split", F.lit("validation")))
    return round_doubles(made.select("split", "customer_id", "column_name", "category", "statistic"))


# --- the portfolio by a trained model -----------------------------------------------


@register("batch_scoring_model", sql(*CHAIN, *prepared_sql(), *logistic_sql(), body=f"""
SELECT customer_id, round(p, 6) AS churn_probability, CASE WHEN p < {WATCHLIST_THRESHOLD} THEN 'Low'
  WHEN p < {CLASSIFICATION_THRESHOLD} THEN 'Medium' ELSE 'High' END AS risk_band,
  CAST(p >= {CLASSIFICATION_THRESHOLD} AS INTEGER) AS churn_prediction
FROM (SELECT customer_id, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xv, co)"""))
def batch_scoring_model(spark, sf):
    """Whole-portfolio scoring with a trained model: logistic regression fitted on the training split."""
    from churnlake.oracle import SCORED_AT
    from churnlake.plans.scoring import score_portfolio
    prep, rows = _vectors(spark, sf)
    beta = R.fit_logistic(rows, prep.fits, len(prep.names))

    def scorer(mart):
        vectors = prep.vectors(mart.withColumn("fit", F.lit(0)), "fit", "customer_id")
        return R.predict_logistic(beta, vectors, "customer_id").withColumnRenamed("score", "churn_probability")
    out = score_portfolio(mart_df(spark, sf), scorer, scored_at=SCORED_AT)
    return round_doubles(out.select("customer_id", "churn_probability", "risk_band", "churn_prediction"))
