"""Diurnal, monthly and seasonal profiles, correlations by group, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insolara.functions import scores
from insolara.functions.columns import ratio
from insolara.functions.timecol import by_column, month_name
from insolara.operators.quantiles import box_stats
from insolara.operators.reshape import join_groups, melt

# Distance from 1 that counts as exactly 1 (rounding of the square roots).
ONE_TOLERANCE = 1e-12


def hour_mean(df: DataFrame, columns: Sequence[str], dt: str = "dt") -> DataFrame:
    """The diurnal cycle."""
    return df.groupBy(F.hour(dt).alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])


def hour_mean_scaled(df: DataFrame, columns: Sequence[str], regime: str = "regime", dt: str = "dt") -> DataFrame:
    """Diurnal cycle of each variable divided by its maximum within the regime.

    The maxima ride along in the hourly aggregate; the second step sees at most
    24 rows per regime.
    """
    hourly = df.groupBy(regime, F.hour(dt).alias("hour")).agg(
        *[F.avg(c).alias(c) for c in columns], *[F.max(c).alias(f"_max_{c}") for c in columns])
    whole = Window.partitionBy(regime)
    scaled = hourly.select(regime, "hour", *[
        F.try_divide(F.col(c), F.max(f"_max_{c}").over(whole)).alias(c) for c in columns])
    return melt(scaled, [regime, "hour"], columns)


def hour_mean_by(df: DataFrame, columns: Sequence[str], by: str, dt: str = "dt") -> DataFrame:
    """Diurnal cycle per month or season, all slices in one pass."""
    grouped = df.groupBy(by_column(F.col(dt), by).alias(by), F.hour(dt).alias("hour"))
    return melt(grouped.agg(*[F.avg(c).alias(c) for c in columns]), [by, "hour"], columns)


def _correlations(df: DataFrame, keys: Sequence[Column], names: Sequence[str], x: Sequence[str], y: str,
                  drop_exact_one: bool) -> DataFrame:
    """All correlations of one grouping in one aggregate; only the result is unfolded."""
    made = df.groupBy(*keys).agg(*[scores.correlation(F.col(c), F.col(y)).alias(c) for c in x])
    rows = melt(made, names, x, value="corr").where(F.col("corr").isNotNull())
    return rows.where(F.abs(F.col("corr") - 1) > ONE_TOLERANCE) if drop_exact_one else rows


def corr_by(df: DataFrame, x: str, y: str, by: str, dt: str = "dt", drop_exact_one: bool = False) -> DataFrame:
    """Correlation of two columns per hour, month or season."""
    rows = _correlations(df, [by_column(F.col(dt), by).alias(by)], [by], [x], y, drop_exact_one)
    return rows.select(by, "corr")


def corr_by_slice_hour(df: DataFrame, x: Sequence[str], y: str, by: str, dt: str = "dt",
                       drop_exact_one: bool = False) -> DataFrame:
    """Correlation of several columns with one, per month or season and hour."""
    keys = [by_column(F.col(dt), by).alias(by), F.hour(dt).alias("hour")]
    return _correlations(df, keys, [by, "hour"], x, y, drop_exact_one)


def corr_by_regime_hour(df: DataFrame, x: Sequence[str], y: str, regime: str = "regime", dt: str = "dt",
                        drop_exact_one: bool = False) -> DataFrame:
    keys = [F.col(regime), F.hour(dt).alias("hour")]
    return _correlations(df, keys, [regime, "hour"], x, y, drop_exact_one)


def normalise_by_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns divided by their maximum over the slice (or over everything).

    Maxima are aggregated first and joined back, so a heavy slice is never
    gathered in one task as a window would do.
    """
    tops = df.groupBy(*by).agg(*[F.max(c).alias(f"_top_{c}") for c in columns])
    if by:
        joined = join_groups(df, tops, by)
        rest = {c: F.try_divide(F.col(c), F.col(f"_top_{c}")).alias(c) for c in columns}
        return joined.select(*[rest.get(c, F.col(c)) for c in df.columns])
    top = df.agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("t")).scalar()
    marked = df.withColumn("_top", top)
    return marked.withColumns({c: F.try_divide(F.col(c), F.col(f"_top.{c}")) for c in columns}).drop("_top")


def box_stats_by(df: DataFrame, columns: Sequence[str], by: str | None = None, normalise: str = "none",
                 dt: str = "dt", exact: bool = True, axis: str = "hour") -> DataFrame:
    """Box statistics per hour (or other ``axis``) and variable, optionally per month or season slice."""
    if normalise not in ("none", "slice_max", "global_max"):
        raise ValueError("normalise must be none, slice_max or global_max")
    keys = ([by] if by and by != axis else []) + [axis]
    made = {k: by_column(F.col(dt), k) for k in keys}
    rows = df.select(*[c.alias(k) for k, c in made.items()], *columns)
    if normalise == "slice_max" and len(keys) > 1:
        rows = normalise_by_max(rows, columns, [by])
    elif normalise != "none":
        rows = normalise_by_max(rows, columns)
    return box_stats(melt(rows, keys, columns), [*keys, "var"], "value", exact)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal bins between minimum and maximum per column, last bin closed, empty bins kept.

    Both passes reduce to one row per task: bounds first, then one counter per
    column and bin.
    """
    bounds = df.agg(F.struct(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
                               for c in columns]).alias("b")).scalar()
    held = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_b", bounds)
    counters = []
    for c in columns:
        lo, hi = F.col(f"_b.{c}.lo"), F.col(f"_b.{c}.hi")
        share = F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.5))
        place = F.when(F.col(c).isNotNull(), F.least(F.floor(share * bins), F.lit(bins - 1)))
        held = held.withColumn(f"_bin_{c}", place.cast("int"))
        counters.append(F.struct(
            F.lit(c).alias("var"), F.max(lo).alias("lo"), F.max(hi).alias("hi"),
            F.array(*[F.count_if(F.col(f"_bin_{c}") == i) for i in range(bins)]).alias("counts")))
    made = held.agg(F.array(*counters).alias("c")).select(F.inline("c"))
    flat = F.col("lo") == F.col("hi")
    first = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    last = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    width = (last - first) / bins
    return made.select("var", first.alias("_lo"), width.alias("_w"), F.posexplode("counts").alias("bin", "n")).select(
        "var", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right_edge"), "n")


def scatter_by(df: DataFrame, x: str, y: str, by: str, dt: str = "dt") -> DataFrame:
    """Point pairs labelled with their hour or month."""
    return df.select(by_column(F.col(dt), by).alias("by"), F.col(x).alias("x"), F.col(y).alias("y"))


def scatter_month(df: DataFrame, x: str, y: str, months: Sequence[int] | None = None, dt: str = "dt") -> DataFrame:
    """Point pairs labelled with the month name, all months or the listed ones."""
    rows = df if months is None else df.where(F.month(dt).isin(sorted(set(months))))
    return rows.select(month_name(F.col(dt), short=True).alias("month"), F.col(x).alias("x"), F.col(y).alias("y"))


def zenith_ratio(df: DataFrame, model: str, observed: str, zenith: Column, months: Sequence[int] | None = None,
                 dt: str = "dt") -> DataFrame:
    """Model/observation ratio against the zenith; rows without a ratio are dropped."""
    rows = df.withColumns({"zenith": zenith, "ratio": ratio(F.col(model), F.col(observed))})
    return scatter_month(rows.na.drop(subset=["zenith", "ratio"]), "zenith", "ratio", months, dt)
