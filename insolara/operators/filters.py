"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.functions import timecol

# Named areas as (lon, lon, lat, lat), in the order they are usually listed.
AREAS = {
    "reu": (55.0, 56.0, -21.5, -20.8),
    "swio": (20.0, 110.0, -50.0, 9.0),
    "reu_mau": (52.0, 60.0, -17.9, -23.0),
}

# Analysis window, months of the season, daytime and long-day hours.
SEASON_START, SEASON_END = "2004-11-01 00:00:00", "2005-04-30 23:59:00"
SEASON_MONTHS = (11, 12, 1, 2, 3, 4)
DAY_HOURS = (8, 17)
LONG_DAY_HOURS = (5, 20)


def _moment(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def time_range(df: DataFrame, lo: str | Column, hi: str | Column, dt: str = "dt") -> DataFrame:
    """Both bounds inclusive; reaches the scan as a pushed filter."""
    return df.where((F.col(dt) >= _moment(lo)) & (F.col(dt) <= _moment(hi)))


def hour_range(df: DataFrame, first: int = DAY_HOURS[0], last: int = DAY_HOURS[1], dt: str = "dt") -> DataFrame:
    """Hours of the day, inclusive; pair it with :func:`time_range` so the scan can prune."""
    return df.where(F.hour(dt).between(first, last))


def exclude_stations(df: DataFrame, ids: Sequence[int], column: str = "station_id") -> DataFrame:
    return df.where(~F.col(column).isin(list(ids))) if ids else df


def station_filter(df: DataFrame, station: int, column: str = "station_id") -> DataFrame:
    return df.where(F.col(column) == station)


def month_slice(df: DataFrame, months: Sequence[int] = SEASON_MONTHS, dt: str = "dt") -> DataFrame:
    """Rows of the listed months with their ``month``; repeated months count once."""
    return df.withColumn("month", F.month(dt)).where(F.col("month").isin(sorted(set(months))))


def season_slice(df: DataFrame, seasons: Sequence[int] = (1, 2, 3, 4), dt: str = "dt") -> DataFrame:
    return df.withColumn("season", timecol.season(F.col(dt))).where(F.col("season").isin(sorted(set(seasons))))


def block_slice(df: DataFrame, blocks: Sequence[str] = tuple(timecol.TRAINING_BLOCKS), dt: str = "dt") -> DataFrame:
    return (df.withColumn("training_block", timecol.training_block(F.col(dt)))
            .where(F.col("training_block").isin(list(blocks))))


def area_box(area: str) -> tuple[float, float, float, float]:
    """(lon_min, lon_max, lat_min, lat_max) of a named area."""
    if area not in AREAS:
        raise ValueError(f"unknown area {area!r}; use one of {sorted(AREAS)}")
    west, east, one, other = AREAS[area]
    return min(west, east), max(west, east), min(one, other), max(one, other)


def bbox(df: DataFrame, area: str | tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a named area or a (lon, lon, lat, lat) box, edges included."""
    if isinstance(area, str):
        west, east, south, north = area_box(area)
    else:
        west, east = sorted(area[:2])
        south, north = sorted(area[2:])
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def around(df: DataFrame, lon_at: float, lat_at: float, reso: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Box of half a resolution around one point."""
    half = reso / 2
    return bbox(df, (lon_at - half, lon_at + half, lat_at - half, lat_at + half), lon, lat)


def stride(df: DataFrame, n: int, iy: str = "iy", ix: str = "ix") -> DataFrame:
    """Every n-th grid point along both axes."""
    return df if n == 1 else df.where((F.col(iy) % n == 0) & (F.col(ix) % n == 0))


def at_time(df: DataFrame, moments: Sequence[str], time: str = "time") -> DataFrame:
    return df.where(F.col(time).isin([_moment(m) for m in moments]))


def at_hour(df: DataFrame, hours: Sequence[int], time: str = "time") -> DataFrame:
    return df.where(F.hour(time).isin(list(hours)))


def regime_rows(df: DataFrame, rule: Column, clear: str = "clear", cloudy: str = "cloudy") -> DataFrame:
    """One frame with a ``regime`` column in place of two frames side by side."""
    return df.withColumn("regime", F.when(rule, clear).otherwise(cloudy))


def cluster_filter(df: DataFrame, label: int, column: str = "cluster") -> DataFrame:
    return df.where(F.col(column) == label)
