"""Least squares and components from a distributed QR factorisation.

Every task reduces its rows to a triangular factor, factors are stacked and reduced again in a tree, and one
triangle of the size of the model reaches the driver. Nothing is squared on the way, so columns that are
nearly dependent keep twice the digits that sums of squares and products would leave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.functions.nulls import drop_incomplete
from insolara.operators.mixture import whole_vector
from insolara.operators.partials import Batches, combined, matrix


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of the rows' vectors ``x`` behind a column of ones; the diagonal is not negative.

    Its first row holds the number of rows and the means (times its root), the rest is the factor of the
    centred columns.
    """
    size = width + 1

    def reduced(stacked: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(stacked.reshape(-1, size), mode="r")
        r = np.concatenate([r, np.zeros((size - len(r), size))])
        return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]

    def task(batches: Batches) -> Iterator[tuple[int, np.ndarray]]:
        r = np.zeros((0, size))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x", width)
                r = reduced(np.concatenate([r, np.concatenate([np.ones((len(x), 1)), x], axis=1)]))
        if len(r):
            yield 0, r.ravel()

    made = combined(rows.select("x"), task, lambda parts: reduced(parts).ravel())
    if not made:
        raise ValueError("no complete rows")
    return made[0].reshape(size, size)


def _arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = drop_incomplete(df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]))
    return rows.select(F.array(*columns).alias("x"))


def least_squares(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Ordinary least squares as ``term, coefficient`` over complete rows; of dependent columns the shortest solution."""
    r, k = triangle(_arrays(df, [*x, y]), len(x) + 1), len(x)
    root, means, inner = r[0, 0], r[0, 1:] / r[0, 0], r[1:, 1:]
    scale = np.linalg.norm(inner[:, :k], axis=0)
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(inner[:, :k] / scale, inner[:, k], rcond=np.finfo(float).eps * root)[0] / scale
    rows = [("intercept", float(means[k] - means[:k] @ slopes)), *[(c, float(s)) for c, s in zip(x, slopes)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def component_rows(r: np.ndarray) -> list[tuple[int, float, float, list[float]]]:
    """(component, variance, percent, loadings) of the standardised columns of a triangle, largest first.

    Columns are standardised with n, the covariance uses n - 1, hence the factor. The largest loading is positive.
    """
    n, inner = r[0, 0] ** 2, r[1:, 1:]
    spread = np.linalg.norm(inner, axis=0)
    spread[spread == 0] = 1.0
    _, values, axes = np.linalg.svd(inner / spread)
    variances = values ** 2 * (n / (n - 1))
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return [(place, float(v), float(v / variances.sum() * 100), (axis * sign).tolist())
            for place, (v, axis, sign) in enumerate(zip(variances, axes, signs), start=1)]


_COMPONENTS = "component int, variance double, percent double, loadings array<double>"


def components(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Principal components of standardised columns with their loadings."""
    return df.sparkSession.createDataFrame(component_rows(triangle(_arrays(df, columns), len(columns))), _COMPONENTS)


def vector_components(df: DataFrame, column: str, width: int) -> DataFrame:
    """The same for an array column; vectors of another length or with a missing or non-finite entry are left out."""
    rows = df.select(whole_vector(F.col(column), width).alias("x")).where(F.col("x").isNotNull())
    return df.sparkSession.createDataFrame(component_rows(triangle(rows, width)), _COMPONENTS)
