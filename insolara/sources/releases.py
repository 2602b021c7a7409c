"""Forecast releases: one small text file per valid hour and release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.columns import PARITY_KELVIN_OFFSET, kelvin_to_celsius
from insolara.functions.timecol import epoch_micros_utc, whole_hour

# Name of a release file and the line (from 0) that carries the value.
FILE_FORMAT = "temp_pred.{hour}.release_{release}.xml"
FILE_NAME = FILE_FORMAT.replace(".", r"\.").format(hour=r"(\d{10})", release=r"(\d+)") + "$"
VALUE_LINE = 10


def list_release_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modified`` of every release file of a folder; no file is opened."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", FILE_FORMAT.format(hour="*", release="*")).load(folder)
            .select("path", F.col("modificationTime").alias("modified")))


def read_release_files(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """``path, modified, content`` of every file that matches ``glob`` (or of the paths of a list)."""
    return (spark.read.text(glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_modification_time").alias("modified"),
                    F.col("value").alias("content")))


def _named(df: DataFrame) -> DataFrame:
    """Release files by their names, with release and valid hour."""
    return df.where(F.regexp_like(F.col("path"), F.lit(FILE_NAME))).withColumns({
        "release": F.regexp_extract("path", FILE_NAME, 2).cast("bigint"),
        "dt": F.to_timestamp_ntz(F.regexp_extract("path", FILE_NAME, 1), F.lit("yyyyMMddHH"))})


def newest_release_files(spark: SparkSession, folder: str, now: str, hours: int = 24) -> DataFrame | None:
    """``path, modified, content`` of the newest release's files from the current hour on, ``hours`` of them at most.

    Names and times of all files are listed, and only the files asked for are opened; their paths, one per
    hour, pass the driver. Of several files of one hour the newest counts. None if there is no such file.
    """
    start = whole_hour(F.lit(now).cast("timestamp_ntz"))
    named = _named(list_release_files(spark, folder))
    wanted = (named.where((F.col("dt") >= start) & (F.col("dt") < start + F.make_dt_interval(hours=F.lit(hours))))
              .join(latest_release(named), "release")
              .groupBy("dt").agg(F.max(F.struct("modified", "path"))["path"].alias("path")))
    paths = [r["path"] for r in wanted.orderBy("dt").collect()]
    return read_release_files(spark, paths) if paths else None


def forecast_from_folder(spark: SparkSession, folder: str, now: str, hours: int = 24,
                         offset: float = PARITY_KELVIN_OFFSET, value_line: int = VALUE_LINE) -> DataFrame:
    """:func:`forecast_release` over a folder of which at most ``hours`` files are read."""
    files = newest_release_files(spark, folder, now, hours)
    if files is None:
        return spark.createDataFrame([], "release bigint, dt timestamp_ntz, temp double")
    return forecast_release(files, now, hours, offset, value_line)


def release_columns(df: DataFrame, value_line: int = VALUE_LINE) -> DataFrame:
    """Parse name and content: ``release, dt, kelvin, modified``; unreadable values are NULL."""
    line = F.get(F.split("content", "\n"), F.lit(value_line))
    return _named(df).select("release", "dt", F.trim(line).try_cast("double").alias("kelvin"), "modified")


def latest_release(df: DataFrame) -> DataFrame:
    """One row: the release of the newest file; the larger number wins a tie."""
    return df.agg(F.max(F.struct("modified", "release"))["release"].alias("release"))


def forecast_release(files: DataFrame, now: Column | str, hours: int = 24,
                     offset: float = PARITY_KELVIN_OFFSET, value_line: int = VALUE_LINE) -> DataFrame:
    """Hourly temperatures of the newest release, from the current hour to the first gap.

    ``files`` comes from :func:`read_release_files`; ``now`` is a UTC time. The
    hours present in the window (at most ``hours`` of them) decide the first gap.
    """
    moment = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    start = whole_hour(moment)
    parsed = release_columns(files, value_line)
    newest = latest_release(parsed)
    window = (parsed.where(F.col("kelvin").isNotNull())
              .where((F.col("dt") >= start) & (F.col("dt") < start + F.make_dt_interval(hours=F.lit(hours))))
              .join(newest, "release")
              .groupBy("release", "dt").agg(F.max(F.struct("modified", "kelvin"))["kelvin"].alias("kelvin")))
    ahead = F.floor((epoch_micros_utc(F.col("dt")) - epoch_micros_utc(start)) / F.lit(3_600_000_000)).cast("bigint")
    seen = window.groupBy("release").agg(F.collect_set(ahead).alias("_seen"))
    run = F.array_min(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(hours).cast("bigint")), F.col("_seen")))
    prefix = seen.select("release", run.alias("_run"))
    return (window.join(prefix, "release").where(ahead < F.col("_run"))
            .select("release", "dt", kelvin_to_celsius(F.col("kelvin"), offset).alias("temp")))
