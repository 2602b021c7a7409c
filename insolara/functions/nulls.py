"""Missing values: NaN, infinities and sentinels all become NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the marker for "missing" in training files.
SENTINEL = -99999.0


def finite(value: Column) -> Column:
    """True for a real number; NaN sorts above infinity, so one comparison settles both."""
    return F.abs(value) < F.lit(float("inf"))


def present(value: Column, sentinels: Iterable[float] = ()) -> Column:
    """``value`` where it is a real number, else NULL."""
    good = finite(value)
    for mark in sentinels:
        good = good & (value != F.lit(float(mark)))
    return F.when(good, value)


def inf_to_null(value: Column) -> Column:
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def clean_frame(df: DataFrame, sentinels: Iterable[float] = ()) -> DataFrame:
    """Normalise every floating column at the scan."""
    marks = tuple(sentinels)
    return df.withColumns({c: present(F.col(c), marks) for c in floating_columns(df)})


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a value in every column; NaN and infinities count as missing.

    A plain filter: what passes needs no cleaning, so the values are computed once.
    """
    names = list(columns or df.columns)
    floating = set(floating_columns(df))
    kept = df
    for c in names:
        kept = kept.where(finite(F.col(c)) if c in floating else F.col(c).isNotNull())
    others = [c for c in floating if c not in names]
    return kept.withColumns({c: present(F.col(c)) for c in others}) if others else kept
