"""Text outputs built as one string column and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insolara.functions.columns import fixed_text
from insolara.functions.timecol import LOCAL_ZONE, epoch_ns

# Fixed value: timestamp layout of the text outputs.
STAMP = "yyyy-MM-dd HH:mm:ss"


def series_lines(df: DataFrame, value: str, dt: str = "dt", station: str = "station_id") -> DataFrame:
    """``station,timestamp,value`` with four decimals; rows without a value print ``nan``."""
    number = F.when(F.col(value).isNull(), F.lit("nan")).otherwise(fixed_text(F.col(value), 4))
    return df.select(F.concat_ws(",", F.col(station).cast("string"), F.date_format(dt, STAMP), number).alias("line"))


def write_series_csv(df: DataFrame, path: str, value: str, dt: str = "dt", station: str = "station_id") -> None:
    """Append the lines of all stations to one folder, without header."""
    series_lines(df, value, dt, station).write.mode("append").text(path)


def line_protocol(df: DataFrame, measurement: str, column: str, dt: str = "dt", name: str | None = None,
                  zone: str = LOCAL_ZONE) -> DataFrame:
    """``measurement date_concerned="…",name=0.000 epoch_ns`` lines for a time-series store."""
    text = F.format_string('%s date_concerned="%s",%s=%.3f %d', F.lit(measurement), F.date_format(dt, STAMP),
                           F.lit(name or column), F.col(column), epoch_ns(F.col(dt), zone))
    return df.where(F.col(column).isNotNull()).select(text.alias("line"))


def write_line_protocol(df: DataFrame, path: str, measurement: str, column: str, mode: str = "append",
                        **options: str) -> None:
    line_protocol(df, measurement, column, **options).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A frame as CSV with header."""
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", STAMP).csv(path)


def write_parquet(df: DataFrame, path: str, dt: str = "dt", mode: str = "overwrite") -> None:
    """A table laid out by year and month, so time filters prune whole folders.

    The rebalance hint lets adaptive execution split a heavy month over many
    tasks and join light ones, which keeps file sizes even.
    """
    parts = df.withColumns({"year": F.year(dt), "month": F.month(dt)})
    (parts.hint("rebalance", F.col("year"), F.col("month"))
     .write.mode(mode).partitionBy("year", "month").parquet(path))
