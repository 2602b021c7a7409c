"""Bringing several sources onto the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.functions import columns as C


def align_sources(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("station_id", "dt"),
                  value: str = "value") -> DataFrame:
    """One row per key with a column per source, NULL where a source has none.

    The sources are stacked and aggregated once (one shuffle, combined on the map
    side) in place of a chain of full outer joins; equal keys within a source are
    averaged.
    """
    tagged = [df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(name).alias("_source"))
              for name, df in sources.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    cells = [F.avg(F.when(F.col("_source") == name, F.col("_v"))).alias(name) for name in sources]
    return stacked.groupBy(*keys).agg(*cells)


def align_subtract(predicted: DataFrame, observed: DataFrame, value: str = "value",
                   keys: Sequence[str] = ("dt",)) -> DataFrame:
    """Rows on both sides with ``pred, obs, error``."""
    left = predicted.select(*keys, F.col(value).alias("pred"))
    right = observed.select(*keys, F.col(value).alias("obs"))
    return left.join(right, list(keys)).withColumn("error", C.error(F.col("obs"), F.col("pred")))


def hour_profile_join(df: DataFrame, columns: Sequence[str], dt: str = "dt", suffix: str = "_hour_mean") -> DataFrame:
    """Each row beside the mean of its hour of day; rows without a time stay, without a mean.

    The profile has 24 rows at most, so it is broadcast.
    """
    hourly = df.groupBy(F.hour(dt).alias("hour")).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns])
    return df.withColumn("hour", F.hour(dt)).join(F.broadcast(hourly), "hour", "left")


def concat_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns side by side, matched on keys rather than on position."""
    return left.join(right, list(keys))


def attach_cluster(df: DataFrame, labels: DataFrame, key: str = "station_id", how: str = "inner") -> DataFrame:
    return df.join(labels.select(key, "cluster"), key, how)


def select_times(df: DataFrame, times: DataFrame, dt: str = "dt") -> DataFrame:
    """Rows whose timestamp is listed."""
    return df.join(times.select(dt), dt, "left_semi")


def select_month_days(df: DataFrame, months: Sequence[int], days: Sequence[int], dt: str = "dt") -> DataFrame:
    """Rows on the listed days of the listed months; a plain filter."""
    return df.where(F.month(dt).isin(list(months)) & F.dayofmonth(dt).isin(list(days)))
