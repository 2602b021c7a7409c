"""Group variation, correlation, scalers, principal components and linear regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.functions import scores
from insolara.functions.nulls import drop_incomplete, finite
from insolara.operators.partials import Batches, matrix, summed


def group_variation(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Sample variance and mean per group, and an unweighted overall row (label ``overall``)."""
    stats = df.groupBy(F.col(by).cast("string").alias("group")).agg(
        *[F.var_samp(c).alias(f"var_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in columns])
    names = [n for n in stats.columns if n != "group"]
    overall = stats.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("overall").alias("group"), *names)
    return stats.unionByName(overall)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All-pairs Pearson r over pairwise-complete rows, in one aggregate: ``first, second, corr``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    made = df.agg(*[scores.correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("first"), F.lit(right).alias("second"),
                                  F.col(f"c{i}").alias("corr")))
    return made.select(F.inline(F.array(*cells)))


@dataclass
class Scaler:
    """Fitted z-score: population deviation, 1 for a constant column."""

    columns: list[str]
    means: list[float]
    scales: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                               for c, m, s in zip(self.columns, self.means, self.scales)})

    def mean(self, column: str) -> float:
        return self.means[self.columns.index(column)]

    def scale(self, column: str) -> float:
        return self.scales[self.columns.index(column)]


def scalers_by(df: DataFrame, key: str, columns: Sequence[str]) -> dict[int, Scaler]:
    """One scaler per value of a key with few values, from one aggregate."""
    made = df.groupBy(key).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
    k = len(columns)
    return {r[0]: Scaler(list(columns), [float(r[1 + i]) for i in range(k)], [float(r[1 + k + i]) or 1.0 for i in range(k)])
            for r in made}


def scaler_fit(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    k = len(columns)
    if row[0] is None:
        raise ValueError("cannot fit a scaler without rows")
    return Scaler(list(columns), [float(m) for m in row[:k]], [float(s) or 1.0 for s in row[k:]])


def scaler_transform(fitted: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``df`` by the statistics of ``fitted`` in one lazy plan."""
    stats = fitted.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("s")).scalar()
    held = df.withColumn("_s", stats)

    def scaled(c: str) -> Column:
        spread = F.col(f"_s.s_{c}")
        return (F.col(c) - F.col(f"_s.m_{c}")) / F.when(spread == 0, 1.0).otherwise(spread)

    return held.withColumns({c: scaled(c) for c in columns}).drop("_s")


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0-1 scale; a constant column becomes 0."""
    bounds = df.agg(F.struct(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns]).alias("b")).scalar()
    held = df.withColumn("_b", bounds)

    def scaled(c: str) -> Column:
        span = F.col(f"_b.hi_{c}") - F.col(f"_b.lo_{c}")
        return (F.col(c) - F.col(f"_b.lo_{c}")) / F.when(span == 0, 1.0).otherwise(span)

    return held.withColumns({c: scaled(c) for c in columns}).drop("_b")


@dataclass
class Moments:
    """Count, means and population covariance of a set of columns."""

    n: int
    means: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over complete rows, by native aggregates; only k(k+1)/2 numbers come back."""
    rows = drop_incomplete(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = rows.agg(F.count("*"), *[F.avg(c) for c in columns],
                   *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    n = int(row[0])
    if n == 0:
        raise ValueError("no complete rows")
    k = len(columns)
    cov = np.zeros((k, k))
    for (i, j), value in zip(pairs, row[1 + k:]):
        cov[i, j] = cov[j, i] = value
    return Moments(n, np.array(row[1:1 + k], dtype=float), cov)


def vector_moments(df: DataFrame, column: str, width: int) -> Moments:
    """The same for one array column: means first, then the centred product sums per partition."""
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == width) & F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False)))
    rows = df.select(F.when(whole, x).alias("x")).where(F.col("x").isNotNull())

    def totals(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros(width + 1)
        for batch in batches:
            x = matrix(batch, "x", width)
            acc[0] += len(x)
            acc[1:] += x.sum(axis=0)
        yield 0, acc

    first = summed(rows, totals)[0]
    n = int(first[0])
    if n == 0:
        raise ValueError("no complete rows")
    means = first[1:] / n

    def products(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        acc = np.zeros((width, width))
        for batch in batches:
            centred = matrix(batch, "x", width) - means
            acc += centred.T @ centred
        yield 0, acc.ravel()

    return Moments(n, means, summed(rows, products)[0].reshape(width, width) / n)


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariance as ``first, second, cov`` over complete rows, one aggregate."""
    rows = drop_incomplete(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    pairs = [(a, b) for a in columns for b in columns]
    made = rows.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("cov"))
             for i, (a, b) in enumerate(pairs)]
    return made.select(F.inline(F.array(*cells)))


def pca_components(m: Moments) -> list[tuple[int, float, float, list[float]]]:
    """(component, variance, percent, loadings) of the standardised columns, largest first.

    Columns are standardised with n, the covariance uses n - 1, hence the factor.
    """
    spread = np.sqrt(np.diag(m.cov))
    spread[spread == 0] = 1.0
    standard = m.cov / np.outer(spread, spread) * (m.n / (m.n - 1))
    values, vectors = np.linalg.eigh(standard)
    out = []
    for place, at in enumerate(np.argsort(values)[::-1], start=1):
        axis = vectors[:, at]
        axis = axis if axis[np.argmax(np.abs(axis))] > 0 else -axis
        out.append((place, float(values[at]), float(values[at] / values.sum() * 100), [float(a) for a in axis]))
    return out


def pca_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explained variance per principal component, absolute and in percent."""
    rows = pca_components(moments(df, columns))
    return df.sparkSession.createDataFrame(
        rows, "component int, variance double, percent double, loadings array<double>")


def pca_variance_vector(df: DataFrame, column: str, width: int) -> DataFrame:
    rows = pca_components(vector_moments(df, column, width))
    return df.sparkSession.createDataFrame(
        rows, "component int, variance double, percent double, loadings array<double>")


def linear_regression(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Ordinary least squares as ``term, coefficient`` from one aggregation of moments."""
    m = moments(df, [*x, y])
    k = len(x)
    slopes = np.linalg.lstsq(m.cov[:k, :k], m.cov[:k, k], rcond=None)[0]
    intercept = m.means[k] - m.means[:k] @ slopes
    rows = [("intercept", float(intercept)), *[(c, float(s)) for c, s in zip(x, slopes)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def linear_regression_1x(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of one predictor, per group."""
    a, b = scores.paired(F.col(x).cast("double"), F.col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    return (df.groupBy(*by).agg(slope.alias("slope"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"))
            .select(*by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept")))


def regression_bic(df: DataFrame, observed: str, predicted: str, params: int, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(scores.regression_bic(F.col(observed), F.col(predicted), params).alias("bic"))


def r2_score(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE/SST with the observations as truth."""
    return df.groupBy(*by).agg(scores.r2(F.col(predicted), F.col(observed), truth="obs").alias("r2"))
