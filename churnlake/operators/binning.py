"""Features prepared for learners: imputed, then binned (trees) or scaled (linear models), for several fits at once.

A fit is a set of training rows: the training split, or k - 1 folds. Rows come
as (fit, train, ...): once for every fit that trains on them or is applied to
them, so the statistics of all fits are one grouped pass each and k folds
cost no more passes than one. A numeric column is imputed with its exact
median; its bins are cut at the values of equal ranks of the training rows
(bin = number of cuts below the value, so "bin <= b" is "value <= cut b + 1"),
its scaled form has mean 0 and population deviation 1. A category is imputed
with the mode and becomes one 0/1 feature per training category, all zero for
an unseen one. What is fitted is a few numbers per fit and column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.prefix import bucket_expr, materialize, running_sums
from churnlake.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

BINS = 32


def single_fit(split: DataFrame, train: str = "train", target: str = "validation") -> DataFrame:
    """(fit 0, train, ...): the rows of two splits, of which the first trains."""
    return split.where(F.col("split").isin(train, target)).withColumn("fit", F.lit(0)) \
        .withColumn("train", F.col("split") == train)


def fold_fits(rows: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """(fit, train, ...): every row once for each of k fits; fit f trains on the rows outside fold f."""
    return rows.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .withColumn("train", F.col("fit") != F.col(fold))


@dataclass
class Preparation:
    """Fitted numbers: {fit: {column: ...}} and the categories of all fits."""

    medians: dict[int, dict[str, float]]
    modes: dict[int, dict[str, str]]
    cuts: dict[int, dict[str, list[float]]]
    moments: dict[int, dict[str, tuple[float, float]]]
    categories: dict[str, list[str]]
    numeric: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.fits = sorted(self.medians or self.modes)
        self.names = [*self.numeric, *(f"{c}={v}" for c, vs in self.categories.items() for v in vs)]

    def groups(self) -> dict[str, list[int]]:
        """The places of each column's features in ``names``."""
        out = {c: [i] for i, c in enumerate(self.numeric)}
        at = len(self.numeric)
        for c, values in self.categories.items():
            out[c] = list(range(at, at + len(values)))
            at += len(values)
        return out

    def _by_fit(self, expression) -> Column:
        if len(self.fits) == 1:
            return expression(self.fits[0])
        out = F.when(F.col("fit") == self.fits[0], expression(self.fits[0]))
        for f in self.fits[1:]:
            out = out.when(F.col("fit") == f, expression(f))
        return out

    def imputed(self, df: DataFrame) -> DataFrame:
        new = {c: self._by_fit(lambda f, c=c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[f][c])))
               for c in self.numeric}
        new |= {c: self._by_fit(lambda f, c=c: F.coalesce(F.col(c), F.lit(self.modes[f][c]))) for c in self.categories}
        return df.withColumns(new)

    def _indicators(self) -> list[Column]:
        return [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, vs in self.categories.items() for v in vs]

    def binned(self, df: DataFrame, *keep) -> DataFrame:
        """``keep`` and ``bins`` (array<tinyint>, in the order of ``names``)."""
        bins = [self._by_fit(lambda f, c=c: bucket_expr(c, self.cuts[f][c], False)) for c in self.numeric]
        return self.imputed(df).select(*keep, F.array(*[
            b.cast("tinyint") for b in [*bins, *self._indicators()]]).alias("bins"))

    def vectors(self, df: DataFrame, *keep) -> DataFrame:
        """``keep`` and ``x`` (array<double>): scaled numbers and indicators."""
        scaled = [self._by_fit(lambda f, c=c: (F.col(c) - F.lit(self.moments[f][c][0])) / F.lit(self.moments[f][c][1] or 1.0))
                  for c in self.numeric]
        return self.imputed(df).select(*keep, F.array(*scaled, *[i.cast("double") for i in self._indicators()]).alias("x"))


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(fit, column_name, value, cnt) of the non-null cells, counted before they are exchanged."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select("fit", F.explode(cells).alias("kv")).select("fit", "kv.*").where("value is not null") \
        .groupBy("fit", "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _collected(rows: DataFrame, *values: str) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for r in rows.collect():
        out.setdefault(r["fit"], {})[r["column_name"]] = r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)
    return out


def grouped_medians(train: DataFrame, columns: list[str]) -> dict[int, dict[str, float]]:
    """Exact medians (the mean of the two middle values) by fit and column."""
    by = ["fit", "column_name"]
    cum = running_sums(_long(train, columns, "double"), "value", ["cnt"], by, descending=False, with_totals=True)
    n, last = F.col("total_cnt"), F.col("cum_cnt")
    covers = lambda rank: (last - F.col("cnt") < rank) & (last >= rank)
    lo, hi = covers(F.floor((n + 1) / 2)), covers(F.ceil((n + 1) / 2))
    found = cum.where(lo | hi).groupBy(*by).agg(
        ((F.max(F.when(lo, F.col("value"))) + F.max(F.when(hi, F.col("value")))) / 2).alias("median"))
    return _collected(found, "median")


def grouped_cuts(train: DataFrame, columns: list[str], bins: int) -> dict[int, dict[str, list[float]]]:
    """By fit and column the different values at ranks ceil(k n / bins), k = 1 .. bins - 1."""
    cum = running_sums(_long(train, columns, "double"), "value", ["cnt"], ["fit", "column_name"], descending=False,
                       with_totals=True)
    reached = lambda x: F.least(F.floor(x * bins / F.col("total_cnt")), F.lit(bins - 1))
    hit = cum.where(reached(F.col("cum_cnt")) > reached(F.col("cum_cnt") - F.col("cnt")))
    return _collected(hit.groupBy("fit", "column_name").agg(F.sort_array(F.collect_list("value")).alias("cuts")), "cuts")


def fit_preparation(rows: DataFrame, bins: int = BINS, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
                    scaled: bool = True) -> Preparation:
    """Medians, modes, categories, cuts and moments of the training rows of every fit in ``rows`` (fit, train, ...)."""
    numeric, categorical = list(numeric), list(categorical)
    train = materialize(rows.where("train").select("fit", *numeric, *categorical))
    medians = grouped_medians(train, numeric) if numeric else {}
    modes, categories = {}, {c: [] for c in categorical}
    if categorical:  # as many rows as there are categories in the fits
        counts = _long(train, categorical, "string").collect()
        for r in sorted(counts, key=lambda r: (r["fit"], r["column_name"], -r["cnt"], r["value"])):
            modes.setdefault(r["fit"], {}).setdefault(r["column_name"], r["value"])
            if r["value"] not in categories[r["column_name"]]:
                categories[r["column_name"]].append(r["value"])
    prep = Preparation(medians, modes, {}, {}, {c: sorted(v) for c, v in categories.items()}, numeric)
    imputed = prep.imputed(train)
    if numeric:
        prep.cuts = grouped_cuts(imputed, numeric, bins)
    if numeric and scaled:
        for r in imputed.groupBy("fit").agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in numeric]).collect():
            prep.moments[r["fit"]] = {c: tuple(r[c]) for c in numeric}
    return prep
