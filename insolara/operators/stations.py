"""Station statistics: means, variances, record counts and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions import scores
from insolara.functions.timecol import epoch_micros_utc, past_hour
from insolara.operators.reshape import DAYTIME, step_position
from insolara.session import cut_lineage

_HOUR_MICROS = 3_600_000_000


def _means(df: DataFrame, keys: Sequence, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def station_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _means(df, ["station_id"], columns)


def timestamp_mean(df: DataFrame, columns: Sequence[str], dt: str = "dt") -> DataFrame:
    """Mean over stations per time step."""
    return _means(df, [dt], columns)


def station_month_mean(df: DataFrame, columns: Sequence[str], dt: str = "dt") -> DataFrame:
    return _means(df, [F.month(dt).alias("month"), "station_id"], columns)


def station_hour_mean(df: DataFrame, columns: Sequence[str], dt: str = "dt") -> DataFrame:
    return _means(df, ["station_id", F.hour(dt).alias("hour")], columns)


def station_mae(df: DataFrame, model: str, observed: str, carry: Sequence[str] = ()) -> DataFrame:
    score = scores.mae(F.col(model), F.col(observed)).alias("mae")
    return df.groupBy("station_id").agg(score, *[F.avg(c).alias(c) for c in carry])


def station_variance(df: DataFrame, columns: Sequence[str], dt: str | None = "dt") -> DataFrame:
    """Population variance per station; the first time step stands for the group."""
    first = [F.min(dt).alias(dt)] if dt else []
    return df.groupBy("station_id").agg(*first, *[F.var_pop(c).alias(c) for c in columns])


def attach_location(df: DataFrame, stations: DataFrame, columns: Sequence[str] = ("lon", "lat"),
                    how: str = "left") -> DataFrame:
    """Station columns onto station results; Spark picks the join from the table sizes."""
    return df.join(stations.select("station_id", *columns), "station_id", how)


def record_counts(df: DataFrame, dt: str = "dt", hours: Sequence[int] = tuple(range(24))) -> DataFrame:
    """Records per station (rows) and hour (columns ``h0``…)."""
    at = F.hour(dt)
    return df.groupBy("station_id").agg(*[F.count_if(at == h).alias(f"h{h}") for h in hours])


def record_counts_by_hour(df: DataFrame, stations: Sequence[int], dt: str = "dt") -> DataFrame:
    """The other orientation: one row per hour, one column per listed station."""
    sid = F.col("station_id")
    return (df.groupBy(F.hour(dt).alias("hour"))
            .agg(*[F.count_if(sid == s).alias(f"s{s}") for s in stations]))


def _station_days(df: DataFrame, dt: str) -> DataFrame:
    """Per station, day and minute past the hour: mask of the hours present, first and last step.

    The one reading of the table that the completeness family needs. A day has at most 24 hours, so one
    integer holds them and combines with ``bit_or`` before the shuffle. The result is kept, since months,
    stations, expected and present hours all follow from it. Rows without a time leave a row without a day.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.hour(dt))
    return cut_lineage(df.groupBy(
        "station_id", F.to_date(dt).alias("day"), F.pmod(epoch_micros_utc(F.col(dt)), F.lit(_HOUR_MICROS)).alias("_past")
    ).agg(F.bit_or(bit).alias("_hours"), F.min(dt).alias("_lo"), F.max(dt).alias("_hi")))


def _month_spans(days: DataFrame) -> DataFrame:
    return (days.where(F.col("day").isNotNull()).groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")))


def _presence(days: DataFrame, spans: DataFrame, first: int, last: int) -> DataFrame:
    """Per station and day a bit mask of the expected steps that are present.

    Expected steps are whole hours after the first step of the month.
    """
    offset = F.pmod(epoch_micros_utc(F.col("lo")), F.lit(_HOUR_MICROS))
    span = spans.select("year", "month", offset.alias("_offset"))
    expected = F.when(F.col("_past") == F.col("_offset"), F.col("_hours").bitwiseAND(F.lit(_mask(first, last)))).otherwise(0)
    rows = days.where(F.col("day").isNotNull()).withColumns({"year": F.year("day"), "month": F.month("day")})
    return (rows.join(F.broadcast(span), ["year", "month"])  # one row per calendar month
            .groupBy("station_id", "year", "month", "day").agg(F.bit_or(expected).alias("_mask")))


def _mask(first: int, last: int) -> int:
    return sum(1 << h for h in range(first, last + 1))


def completeness(df: DataFrame, dt: str = "dt", first: int = DAYTIME[0], last: int = DAYTIME[-1]) -> DataFrame:
    """Per month and station: expected, present and missing daytime hours, complete flag, distinct days.

    Every station gets a row for every month of the table. Expected hours are a
    property of the month alone; present hours come from day masks, so the table
    is reduced to one small row per station-day before anything is joined.
    """
    station_days = _station_days(df, dt)
    spans = _month_spans(station_days)
    steps = F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 1 HOUR"))
    expected = spans.select(
        "year", "month",
        F.size(F.filter(steps, lambda t: F.hour(t).between(first, last))).cast("bigint").alias("expected"))
    have = (_presence(station_days, spans, first, last)
            .groupBy("station_id", "year", "month")
            .agg(F.sum(F.bit_count("_mask")).cast("bigint").alias("present"), F.count("*").alias("days")))
    slots = station_months(station_days, expected.select("year", "month", "expected"))
    return (slots.join(have, ["station_id", "year", "month"], "left")
            .select("year", "month", "station_id", "expected",
                    F.coalesce("present", F.lit(0)).cast("bigint").alias("present"),
                    (F.col("expected") - F.coalesce("present", F.lit(0))).cast("bigint").alias("missing"),
                    (F.col("expected") == F.coalesce("present", F.lit(0))).alias("complete"),
                    F.coalesce("days", F.lit(0)).cast("bigint").alias("days")))


def station_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Every station with every row of a month table.

    The months (one row per calendar month) travel as one array value, taken
    once by a scalar subquery; each station row unfolds it.
    """
    names = months.columns
    packed = months.agg(F.sort_array(F.collect_list(F.struct(*names)))).scalar()
    stations = df.select("station_id").where(F.col("station_id").isNotNull()).distinct()
    rows = stations.select("station_id", F.explode(packed).alias("_m"))
    return rows.select("station_id", *[F.col(f"_m.{n}").alias(n) for n in names])


def missing_steps(df: DataFrame, dt: str = "dt", first: int = DAYTIME[0], last: int = DAYTIME[-1]) -> DataFrame:
    """Expected daytime hours without a record, per station and month.

    Expected and present hours meet as day masks; only missing hours are unfolded.
    """
    station_days = _station_days(df, dt)
    return _missing_steps(station_days, _month_spans(station_days), dt, first, last)


def _missing_steps(station_days: DataFrame, spans: DataFrame, dt: str, first: int, last: int) -> DataFrame:
    days = F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY"))
    calendar = station_months(station_days, spans).select("station_id", "year", "month", "lo", "hi", F.explode(days).alias("day"))
    have = _presence(station_days, spans, first, last)
    joined = calendar.join(have, ["station_id", "year", "month", "day"], "left")
    lacking = F.bitwise_not(F.coalesce("_mask", F.lit(0))).bitwiseAND(F.lit(_mask(first, last)))
    hours = F.filter(F.sequence(F.lit(first), F.lit(last)),
                     lambda h: F.call_function("shiftright", F.col("_lack"), h).bitwiseAND(F.lit(1)) == 1)
    gaps = joined.withColumn("_lack", lacking).where(F.col("_lack") != 0).withColumn("_h", F.explode(hours))
    step = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("_h")) + past_hour(F.col("lo"))
    return (gaps.withColumn(dt, step).where((F.col(dt) >= F.col("lo")) & (F.col(dt) <= F.col("hi")))
            .select("year", "month", "station_id", dt))


def missing_map(df: DataFrame, dt: str = "dt", first: int = DAYTIME[0], last: int = DAYTIME[-1]) -> DataFrame:
    """Missing hours with their position in the month's daytime calendar."""
    station_days = _station_days(df, dt)
    spans = _month_spans(station_days)
    steps = F.filter(F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 1 HOUR")),
                     lambda t: F.hour(t).between(first, last))
    position = spans.select("year", "month", F.posexplode(steps).alias("position", dt))
    return (_missing_steps(station_days, spans, dt, first, last).join(position, ["year", "month", dt])
            .select("year", "month", "station_id", dt, F.col("position").cast("bigint").alias("position")))


def month_day_count(df: DataFrame, by: Sequence[str] = (), dt: str = "dt") -> DataFrame:
    """Distinct days of the month per month; at most 31 per group, held as a bit mask."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth(dt))
    return (df.where(F.col(dt).isNotNull()).groupBy(*by, F.month(dt).alias("month"))
            .agg(F.bit_count(F.bit_or(bit)).cast("bigint").alias("days")))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def station_map(values: DataFrame, value: str, bias: bool = False, n: int = 10,
                bounds: tuple[float, float] | None = None) -> DataFrame:
    """Station values with class bounds and class, either fixed bounds or readable ones from the data."""
    if bounds:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
        return values.withColumns({"vmin": lo, "vmax": hi, "class": C.value_class(F.col(value), lo, hi, n)})
    low, high = C.nice_bounds(F.min(value), F.max(value), n, symmetric=bias)
    edges = values.agg(F.struct(low.alias("lo"), high.alias("hi"))).scalar()
    placed = values.withColumn("_edges", edges)
    return (placed.withColumns({"vmin": F.col("_edges.lo"), "vmax": F.col("_edges.hi")}).drop("_edges")
            .withColumn("class", C.value_class(F.col(value), F.col("vmin"), F.col("vmax"), n)))


def station_map_month(df: DataFrame, model: str, observed: str, stations: DataFrame, reach: float = 340.0,
                      n: int = 10, dt: str = "dt") -> DataFrame:
    """Monthly mean bias per station with its location and class between fixed bounds."""
    biased = df.select("station_id", dt, C.bias(F.col(model), F.col(observed)).alias("bias"))
    monthly = station_month_mean(biased, ["bias"], dt)
    classed = monthly.withColumn("class", C.value_class(F.col("bias"), -reach, reach, n))
    return attach_location(classed, stations)


def station_hour_curves(df: DataFrame, model: str, observed: str, stations: DataFrame, dt: str = "dt") -> DataFrame:
    """Hourly mean model minus observation per station, with the altitude."""
    hourly = station_hour_mean(df, [model, observed], dt)
    curve = hourly.select("station_id", "hour", C.bias(F.col(model), F.col(observed)).alias("bias"))
    return attach_location(curve, stations, ["altitude"])


def altitude_variance(df: DataFrame, columns: Sequence[str], model: str, observed: str, stations: DataFrame,
                      dt: str = "dt") -> DataFrame:
    """Variance of each source against altitude, and the variance difference of one model."""
    spread = station_variance(df, columns, None)
    return attach_location(spread.withColumn("bias", C.bias(F.col(model), F.col(observed))), stations, ["altitude"])


def version_diff(df: DataFrame, first: str, second: str, stations: DataFrame) -> DataFrame:
    """Station means of two model versions, their difference and its size."""
    means = station_mean(df, [first, second])
    both = means.withColumns({"diff": C.bias(F.col(first), F.col(second)),
                              "abs_diff": C.abs_diff(F.col(first), F.col(second))})
    return attach_location(both, stations, ["lon", "lat", "altitude"])


def xy_pairs(df: DataFrame, value: str, stations: DataFrame, against: str = "altitude") -> DataFrame:
    """Station mean beside a station property."""
    pairs = attach_location(station_mean(df, [value]), stations, [against], "inner")
    return pairs.select("station_id", F.col(against).alias("x"), F.col(value).alias("y"))


def month_curves(df: DataFrame, columns: Sequence[str], dt: str = "dt") -> DataFrame:
    """Mean over stations per time step as ``month, position, day, source, value``."""
    steps = timestamp_mean(df, columns, dt).withColumn("month", F.month(dt))
    place = step_position(steps, dt, ["month"])
    rows = steps.join(place, ["month", dt])
    return (rows.select("month", "position", F.dayofmonth(dt).alias("day"),
                        *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["month", "position", "day"], list(columns), "source", "value"))
