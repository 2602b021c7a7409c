"""Calendar columns, zone shifts and epoch values over TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: zone of the island; never the zone of the machine.
LOCAL_ZONE = "Indian/Reunion"

# Calendar months of each training block.
TRAINING_BLOCKS = {
    "020304": (2, 3, 4),
    "050607": (5, 6, 7),
    "080910": (8, 9, 10),
    "111201": (11, 12, 1),
}


def hour(dt: Column) -> Column:
    return F.hour(dt)


def whole_hour(dt: Column) -> Column:
    """The full hour of a naive timestamp, without a detour through the session zone."""
    return dt - past_hour(dt)


def past_hour(dt: Column) -> Column:
    """Minutes and seconds since the full hour, as an interval."""
    return F.make_dt_interval(mins=F.minute(dt), secs=F.extract(F.lit("SECOND"), dt))


def whole_month(dt: Column) -> Column:
    return F.trunc(F.to_date(dt), "month").cast("timestamp_ntz")


def weekday(dt: Column) -> Column:
    """Monday is 0."""
    return F.weekday(dt)


def month(dt: Column) -> Column:
    return F.month(dt)


def season(dt: Column) -> Column:
    """December to February is 1, then one number per quarter."""
    return F.floor((F.month(dt) % 12 + 3) / 3).cast("int")


def training_block(dt: Column) -> Column:
    blocks = iter(TRAINING_BLOCKS.items())
    label, months = next(blocks)
    out = F.when(F.month(dt).isin(*months), label)
    for label, months in blocks:
        out = out.when(F.month(dt).isin(*months), label)
    return out


def day_name(dt: Column) -> Column:
    return F.date_format(dt, "EEEE")


def month_name(dt: Column, short: bool = False) -> Column:
    return F.date_format(dt, "MMM" if short else "MMMM")


def calendar_columns(dt: Column) -> dict[str, Column]:
    """The calendar features used as predictors."""
    return {
        "hour": hour(dt),
        "weekday": weekday(dt),
        "month": month(dt),
        "season": season(dt),
        "day_name": day_name(dt),
    }


def utc_to_local(dt: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), dt)


def local_to_utc(dt: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), dt)


def epoch_micros_utc(dt_utc: Column) -> Column:
    """Microseconds since 1970 of a naive UTC timestamp, whatever the session zone."""
    minutes = F.unix_date(F.to_date(dt_utc)).cast("bigint") * 1440 + F.hour(dt_utc) * 60 + F.minute(dt_utc)
    micros = (F.extract(F.lit("SECOND"), dt_utc) * 1000000).cast("bigint")
    return minutes * 60000000 + micros


def epoch_ns(dt_local: Column, zone: str = LOCAL_ZONE) -> Column:
    """Nanoseconds since 1970 of a naive local timestamp, as an exact integer."""
    return epoch_micros_utc(local_to_utc(dt_local, zone)) * F.lit(1000)


def by_column(dt: Column, by: str) -> Column:
    """The grouping column for ``by``: hour, month or season."""
    makers = {"hour": hour, "month": month, "season": season}
    if by.lower() not in makers:
        raise ValueError(f"unknown grouping {by!r}; use one of {sorted(makers)}")
    return makers[by.lower()](dt)
