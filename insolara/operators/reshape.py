"""Positions, prefixes, stacking, pivots and profile vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Daytime hours of the station profiles.
DAYTIME = tuple(range(8, 18))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL group is a group)."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, equal, how).drop(*[f"_right_{k}" for k in keys])


def step_position(df: DataFrame, time: str = "dt", by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Position (from 0) of every distinct time step, per group.

    Three levels keep every group bounded by the clock, whatever the size of a
    series: the steps of one second (at most a million) travel as one sorted
    set, seconds are counted inside their day, and days inside their series.
    """
    keys = list(by)
    moment = F.col(time)
    clock = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    seconds = (df.select(*keys, time).where(moment.isNotNull())
               .groupBy(*keys, F.to_date(moment).alias("_day"), clock.alias("_second"))
               .agg(F.sort_array(F.collect_set(time)).alias("_steps"))
               .withColumn("_n", F.size("_steps")))

    def before(order: str, within: Sequence[str]) -> Column:
        frame = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(frame), F.lit(0))

    days = seconds.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"))
    day_starts = days.select(*keys, "_day", before("_day", keys).alias("_day_start"))
    in_day = seconds.withColumn("_in_day", before("_second", [*keys, "_day"])).drop("_n")
    starts = join_groups(in_day, day_starts, [*keys, "_day"])
    place = F.col("_day_start") + F.col("_in_day") + F.col("_inside")
    return (starts.select(*keys, "_day_start", "_in_day", F.posexplode("_steps").alias("_inside", time))
            .select(*keys, time, place.cast("bigint").alias(name)))


def with_position(df: DataFrame, time: str = "dt", by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``df`` with the position of each row's time step."""
    return join_groups(df, step_position(df, time, by, name), [*by, time])


def contiguous_prefix(df: DataFrame, dt: str = "dt", by: Sequence[str] = (), hours: int | None = None,
                      start: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of each series from its start to the first missing hour, ``hours`` of them at most if given.

    ``start`` names a column with the first expected hour (default: the first hour present). The run
    ends at the least hour whose successor is missing, found by an anti join of the distinct hours,
    so a series of any length needs no window.
    """
    keys = list(by)
    rows = df if value is None else df.where(F.col(value).isNotNull())
    rows = rows.where(F.col(dt).isNotNull())
    origin = F.min(start if start else dt)
    if keys:
        starts = rows.groupBy(*keys).agg(origin.alias("_start"))
        located = join_groups(rows, starts, keys)
    else:
        located = rows.withColumn("_start", rows.agg(origin).scalar())
    inside = located.withColumn("_ahead", _hours_between(F.col("_start"), F.col(dt))).where(F.col("_ahead") >= 0)
    if hours is not None:
        inside = inside.where(F.col("_ahead") < hours)
    present = inside.select(*keys, "_ahead").distinct()
    before = present.select(*keys, (F.col("_ahead") - 1).alias("_ahead"))  # hours that have a successor
    ends = join_groups(present, before, [*keys, "_ahead"], "left_anti")
    run = F.when(F.min("_first") == 0, F.min("_ahead") + 1).otherwise(0)
    if keys:
        firsts = present.groupBy(*keys).agg(F.min("_ahead").alias("_first"))
        runs = join_groups(ends, firsts, keys).groupBy(*keys).agg(run.alias("_run"))
        kept = join_groups(inside, runs, keys).where(F.col("_ahead") < F.col("_run"))
    else:
        ends = ends.withColumn("_first", present.agg(F.min("_ahead")).scalar())
        kept = inside.where(F.col("_ahead") < ends.agg(run).scalar())
    return kept.select(*df.columns)


def _hours_between(start: Column, end: Column) -> Column:
    days = F.date_diff(F.to_date(end), F.to_date(start))
    return days * 24 + F.hour(end) - F.hour(start)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (remaining columns break ties)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                                                  for c in df.columns])


def sort_time(df: DataFrame, dt: str = "dt", *rest: str) -> DataFrame:
    """Time order, for final output only."""
    return df.orderBy(dt, *rest)


def sort_desc(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(column).desc())


def first_steps(df: DataFrame, n: int = 24, dt: str = "dt") -> DataFrame:
    """The first ``n`` rows in time order (a top-n: each task keeps only n rows)."""
    return df.orderBy(dt).limit(n)


def arg_best(df: DataFrame, score: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest score, per group; ties go to the smallest ``columns``."""
    best = F.min(F.struct(score, *columns)).alias("_best")
    picked = df.where(F.col(score).isNotNull()).groupBy(*by).agg(best)
    return picked.select(*by, *[F.col(f"_best.{c}").alias(c) for c in columns], F.col(f"_best.{score}").alias(score))


def above_best(df: DataFrame, score: str, name: str = "delta") -> DataFrame:
    """Score minus the smallest score."""
    return df.withColumn(name, F.col(score) - df.select(F.min(score)).scalar())


def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], var: str = "var", value: str = "value") -> DataFrame:
    """Wide to long in one pass."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), var, value)


def pivot_hours(df: DataFrame, key: str, value: str, dt: str = "dt", hours: Sequence[int] = DAYTIME,
                prefix: str = "h") -> DataFrame:
    """Mean per key and hour as one wide row per key; a single aggregation, hours known beforehand."""
    at = F.hour(dt)
    cells = [F.avg(F.when(at == h, F.col(value))).alias(f"{prefix}{h}") for h in hours]
    return df.where(at.isin(*hours)).groupBy(key).agg(*cells)


def profile_vector(df: DataFrame, key: str, value: str, dt: str = "dt", hours: Sequence[int] = DAYTIME) -> DataFrame:
    """``key, profile, complete``: the hourly means as one array, hour order fixed.

    Profiles with a missing hour are flagged, not lost; models use the complete ones.
    """
    at = F.hour(dt)
    cells = F.array(*[F.avg(F.when(at == h, F.col(value))) for h in hours])
    wide = df.where(at.isin(*hours)).groupBy(key).agg(cells.alias("profile"))
    return wide.withColumn("complete", ~F.exists("profile", lambda v: v.isNull()))
