"""Gridded variables as rows: ``time, iy, ix, var, value`` plus coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.operators.reshape import step_position


def grid_long(df: DataFrame, lat: Sequence[float], lon: Sequence[float], values: str = "values",
              time: str = "time", var: str | None = None, swap_axes: bool = False) -> DataFrame:
    """Turn one ``array<array<double>>`` per time step into one row per cell.

    The coordinate vectors are literals of the plan (an axis, not data), so the
    expansion needs neither a join nor a shuffle. ``swap_axes`` reads the outer
    array as x.
    """
    outer, inner = ("ix", "iy") if swap_axes else ("iy", "ix")
    keep = [time] + ([var] if var else [])
    rows = df.select(*keep, F.posexplode(values).alias(outer, "_row"))
    cells = rows.select(*keep, outer, F.posexplode("_row").alias(inner, "value"))
    lats = F.array(*[F.lit(float(v)) for v in lat])
    lons = F.array(*[F.lit(float(v)) for v in lon])
    return cells.select(*keep, "iy", "ix", F.get(lats, F.col("iy")).alias("lat"),
                        F.get(lons, F.col("ix")).alias("lon"), "value")


def grid_times_from_start(df: DataFrame, start: str, step_index: str = "step", time: str = "time") -> DataFrame:
    """Time column as start + n hours for files that only count their steps."""
    origin = F.lit(start).cast("timestamp_ntz")
    return df.withColumn(time, origin + F.make_dt_interval(hours=F.col(step_index)))


def merge_time(df: DataFrame, order_col: str = "file_seq", keys: Sequence[str] = ("time", "iy", "ix", "var"),
               value: str = "value") -> DataFrame:
    """Merge time-overlapping files: of equal steps the one from the first file stays.

    Both aggregates hold plain numbers, so they hash and combine on the map side: any number of copies
    of one step costs one row per task. Equal files keep the least value.
    """
    least = df.groupBy(*keys, order_col).agg(F.min(value).alias(value))
    return least.groupBy(*keys).agg(F.min(order_col).alias(order_col), F.min_by(value, order_col).alias(value))


def count_steps(df: DataFrame, time: str = "time") -> DataFrame:
    """Number of distinct time steps after a merge."""
    return df.agg(F.count_distinct(F.col(time)).alias("steps"))


def slice_steps(df: DataFrame, lo: int, hi: int, time: str = "time") -> DataFrame:
    """Rows whose time step has index lo..hi (from 0, inclusive) among all distinct steps."""
    steps = step_position(df, time).where(F.col("position").between(lo, hi))
    return df.join(steps, time).withColumnRenamed("position", "step")
