"""Generated time steps and the expected daytime calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.functions.timecol import epoch_micros_utc

# Frequency codes and their interval.
FREQUENCIES = {
    "s": "1 second", "min": "1 minute", "H": "1 hour", "D": "1 day", "w": "7 days", "m": "1 month",
    "60min": "60 minutes",
}


def _step(freq: str) -> Column:
    text = FREQUENCIES.get(freq, freq)
    amount, unit = text.split()
    return F.expr(f"INTERVAL {int(amount)} {unit.rstrip('s')}")


def expand_days(days: DataFrame, day: str, freq: str, periods: int, name: str = "dt") -> DataFrame:
    """For each start ``periods`` timestamps ``freq`` apart; duplicates removed.

    Starts are made distinct before the expansion, which keeps the shuffle small
    when many rows share a day.
    """
    start = F.col(day).cast("timestamp_ntz")
    starts = days.select(start.alias("_start")).where(F.col("_start").isNotNull()).distinct()
    steps = F.sequence(F.lit(0), F.lit(periods - 1)) if periods > 0 else F.array().cast("array<int>")
    unit = _step(freq)
    return starts.select(F.explode(F.transform(steps, lambda i: F.col("_start") + unit * i)).alias(name)).distinct()


def step_times(df: DataFrame, start: str, n: str, keys: Sequence[str] = (), name: str = "dt") -> DataFrame:
    """start + i hours for i < n, with ``start`` and ``n`` taken from each row."""
    counts = F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    return (df.where(F.col(n) > 0).select(*keys, F.col(start).alias("_s"), F.explode(counts).alias("_i"))
            .select(*keys, (F.col("_s") + F.make_dt_interval(hours=F.col("_i"))).alias(name)))


def month_spans(df: DataFrame, dt: str = "dt") -> DataFrame:
    """First and last step of every month over all stations: ``year, month, lo, hi``."""
    return (df.where(F.col(dt).isNotNull()).groupBy(F.year(dt).alias("year"), F.month(dt).alias("month"))
            .agg(F.min(dt).alias("lo"), F.max(dt).alias("hi")))


def daytime_calendar(df: DataFrame, dt: str = "dt", first: int = 8, last: int = 17) -> DataFrame:
    """Hourly steps from the first to the last step of each month, daytime hours only."""
    hourly = F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 1 HOUR"))
    steps = month_spans(df, dt).select("year", "month", F.explode(hourly).alias(dt))
    return steps.where(F.hour(dt).between(first, last))


def hours_from(start: Column, dt: Column) -> Column:
    """Whole and part hours between two naive timestamps."""
    return (epoch_micros_utc(dt) - epoch_micros_utc(start)) / F.lit(3_600_000_000)
