"""Training sets from delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insolara.functions.nulls import SENTINEL, clean_frame, drop_incomplete
from insolara.functions.solar import solar_zenith_local
from insolara.functions.timecol import LOCAL_ZONE, calendar_columns

# Fixed value: day-first timestamps of the training files.
DAY_FIRST = "dd/MM/yyyy HH:mm[:ss]"


def training_features(df: DataFrame, columns: list[str], dt: str = "dt", zone: str = LOCAL_ZONE) -> DataFrame:
    """Add calendar features (and the solar zenith if asked for), project, keep complete rows."""
    made = calendar_columns(F.col(dt))
    if "zenith" in columns and "zenith" not in df.columns:
        made["zenith"] = solar_zenith_local(F.col(dt), zone=zone)
    missing = [c for c in columns if c not in made and c not in df.columns]
    if missing:
        raise ValueError(f"columns not available: {missing}")
    wanted = [F.col(dt)] + [(made[c] if c in made else F.col(c)).alias(c) for c in columns if c != dt]
    return drop_incomplete(df.select(*wanted))


def read_training(spark: SparkSession, path: str, schema: T.StructType, columns: list[str],
                  time_column: str = "DateTime", time_format: str = DAY_FIRST) -> DataFrame:
    """Read a comma-separated training set; ``-99999`` counts as missing.

    ``schema`` names the file's columns in order; the time column is read as
    text there and parsed day first.
    """
    raw = (spark.read.schema(schema).option("header", True).option("nullValue", "-99999")
           .option("enforceSchema", True).csv(path))
    timed = clean_frame(raw, sentinels=(SENTINEL,)).withColumn(
        "dt", F.to_timestamp_ntz(F.col(time_column), F.lit(time_format)))
    return training_features(timed.drop(time_column), columns)
