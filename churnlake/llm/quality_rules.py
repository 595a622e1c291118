"""Quality rules: text statistics and minimum-covariance-determinant outliers, in DataFrame functions only.

Base statistics are array expressions on one row. The transformed vector of
each document that passes the base rules is compared with a robust centre
and covariance of its language and source: from several starts, C-steps keep
the 75 % of a group with the smallest Mahalanobis distances and re-estimate,
which never raises the determinant; the start with the smallest determinant
wins. Groups stay rows of a table; a row meets its group's estimate by
(group, salt), and every step is a grouped aggregate with map-side
combining, so one hot source is no single task. What a step needs is written
first, so a plan has one join of the rows and one aggregate, however many
steps there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import SPACE_RE, stage

FEATURES = ("x0", "x1", "x2", "x3", "x4")
P = len(FEATURES)
# Chi-squared with 5 degrees of freedom at 0.975, and the factor that makes the covariance of the
# nearest 75 % consistent for normal data.
CHI2_975, CONSISTENCY = 12.8325, 1.41
#: Standard deviations below which a feature is not resolved (its measurement grain).
GRAIN = (0.25, 0.08, 0.08, 0.25, 0.2)
#: Share of a group whose distances are kept in a C-step.
CORE = 0.75
#: A group with fewer rows is pooled with the small groups of its language, then of the table.
MIN_ROWS = 60
STEPS = 6
STARTS = 3
#: A group's rows are joined with its estimate in so many parts.
SALTS = 32
#: Squared distances are rejected beyond the 0.999 quantile of chi-squared with 5 degrees of freedom.
CUTOFF = 20.515


def _entry(i: int, j: int) -> str:
    return f"c{i}{j}"


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) for column ``text``.

    Null counts as empty. Linear in the text but for one sort of its 3-word windows.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumn("_w", F.array_remove(F.split(t, SPACE_RE), "")).withColumn(
        "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    d = d.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i - 1))))
    few = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_d", h), i)), lambda i: i.isNotNull())
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.size("_d") > 24, pairs))
    many = F.transform(F.filter("_p", lambda x, i: (x["h"] == F.get("_p", i - 1)["h"])
                                | (x["h"] == F.get("_p", i + 1)["h"])), lambda x: x["i"])
    d = d.withColumn("_at", F.when(F.col("_p").isNotNull(), many).when(F.col("_d").isNotNull(), few))
    covered = F.size(F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1),
                                               F.transform("_at", lambda i: i + 2))))
    return d.select(
        *docs.columns, F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _features() -> list[Column]:
    n = F.col("n_words").cast("double")
    return [F.log(n), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
            F.sqrt(10 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _whitened(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with mean m_i and covariance c_ij -> mean, inverse Cholesky factor w_ij, log determinant."""
    g = moments
    for i in range(P):  # the grain keeps a constant feature from a zero variance
        g = g.withColumn(_entry(i, i), F.col(_entry(i, i)) + GRAIN[i] ** 2)
    for j in range(P):
        left = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(_entry(j, j)) - left, F.lit(GRAIN[j] ** 2 / 16))))
        for i in range(j + 1, P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            g = g.withColumn(f"l{i}{j}", (F.col(_entry(i, j)) - dot) / F.col(f"l{j}{j}"))
    for j in range(P):
        g = g.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            g = g.withColumn(f"w{i}{j}", -dot / F.col(f"l{i}{i}"))
    return g.select(*keys, *[f"m{i}" for i in range(P)],
                    *[f"w{i}{j}" for i in range(P) for j in range(i + 1)],
                    sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("logdet"))


def _distance() -> Column:
    dev = [F.col(FEATURES[i]) - F.col(f"m{i}") for i in range(P)]
    z = [sum((F.col(f"w{i}{j}") * dev[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((v * v for v in z), F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance of the features by group, in one pass."""
    out = [F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)]
    out += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(_entry(i, j)) for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*out)


def _salted(groups: DataFrame) -> DataFrame:
    """One copy of a group's row for each part of its rows."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _median_start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise median, and squared scaled median deviation as diagonal covariance."""
    mid = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(FEATURES)])
    dev = rows.join(_salted(mid), ["grp", "salt"]).groupBy("grp").agg(*[
        F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000).alias(f"s{i}")
        for i, x in enumerate(FEATURES)], *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)])
    return dev.select("grp", F.lit(0).alias("start"), *[f"m{i}" for i in range(P)], *[
        (F.pow(1.4826 * F.col(f"s{i}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(_entry(i, j))
        for i in range(P) for j in range(i + 1)])


def mcd(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(grp, m_i, w_ij, logdet): robust centre and whitening factor of each group of ``rows`` (grp, id, features)."""
    rows = stage(spark, rows.select("grp", "id", *FEATURES, F.pmod(F.xxhash64("id", *FEATURES), F.lit(SALTS))
                                    .cast("int").alias("salt")), "mcd_rows")
    starts = _median_start(rows)
    for k in range(1, STARTS):  # a start from a tenth of the rows, picked by their hash
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)) == 0)
        starts = starts.unionByName(_moments(some, ["grp"]).withColumn("start", F.lit(k)))
    keys = ["grp", "start"]
    fit = stage(spark, _whitened(starts, keys), "mcd")
    for _ in range(STEPS):
        far = rows.join(_salted(fit), ["grp", "salt"])
        edge = far.groupBy(*keys).agg(F.percentile_approx(_distance(), CORE, 10000).alias("edge"))
        fit = stage(spark, fit.join(edge, keys), "mcd_edge")
        core = rows.join(_salted(fit), ["grp", "salt"]).where(_distance() <= F.col("edge")).select(*keys, *FEATURES)
        fit = stage(spark, _whitened(_moments(core, keys), keys), "mcd")
    best = fit.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", "b.start")
    fit = stage(spark, fit.join(best, keys), "mcd")

    # one reweighting step: all rows inside the 0.975 quantile
    near = rows.join(_salted(fit), ["grp", "salt"]).where(_distance() <= CHI2_975 * CONSISTENCY).select("grp", *FEATURES)
    return stage(spark, _whitened(_moments(near, ["grp"]), ["grp"]), "mcd")


def quality_verdicts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, statistics, base_failed, kept, distance2, text_group) and the columns ``keep``, one row per input row.

    base_failed: under 50 words, or more than half of the words in 3-word
    windows that the text repeats. kept: not base_failed, and squared robust
    distance of at most CUTOFF.

    Defined results: null text has no words and fails the base rules; null
    language or source are groups of their own; groups under MIN_ROWS are
    pooled by language, then over the table, and a pool that is still
    smaller rejects nothing by distance (distance2 null); repeated rows
    count as rows; extra columns are ignored; an empty table gives an empty
    result.
    """
    def named(tag, c):
        return F.coalesce(F.concat(F.lit(tag), F.col(c).cast("string")), F.lit("-"))

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                      named("l:", lang_col).alias("lang"), named("s:", source_col).alias("src"), *keep)
    stats = text_statistics(src).drop("text").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = stats.select("*", *[F.when(~F.col("base_failed"), x).alias(FEATURES[i])
                                for i, x in enumerate(_features())])
    stats = stage(spark, stats, "statistics")
    good = stats.where("not base_failed")
    by_source = good.groupBy("lang", "src").agg(F.count(F.lit(1)).alias("n_src"))
    sizes = by_source.groupBy("lang").agg(
        F.sum(F.when(F.col("n_src") < MIN_ROWS, F.col("n_src")).otherwise(0)).alias("n_lang"))
    groups = stage(spark, by_source.join(sizes, "lang").select(
        "lang", "src", F.when(F.col("n_src") >= MIN_ROWS, F.concat_ws("\x01", "lang", "src"))
        .when(F.col("n_lang") >= MIN_ROWS, F.col("lang")).otherwise(F.lit("")).alias("grp"), "n_src"), "groups")
    big = groups.groupBy("grp").agg(F.sum("n_src").alias("n")).where(F.col("n") >= MIN_ROWS).select("grp")
    groups = groups.join(big, "grp", "left_semi").select("lang", "src", "grp")
    fit = mcd(spark, good.join(groups, ["lang", "src"]).select("grp", "id", *FEATURES))
    scored = stats.join(groups, ["lang", "src"], "left").join(fit, "grp", "left").withColumn(
        "distance2", F.when(~F.col("base_failed"), _distance()))
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF)).alias("kept"),
        "distance2", F.col("grp").alias("text_group"), *keep)
