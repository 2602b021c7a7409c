"""Station, grid and training tables seen through the standard test tables.

Every view exists twice: as a DataFrame and as SQL text. Only the columns a
query asks for are read, and time bounds are put on the raw column so that
they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.timecol import whole_hour, whole_month

STATIONS = 40

# Schemas of the tables read here; giving them spares a job that opens file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(props: Column) -> Column:
    return F.regexp_extract(props, '"k": ([0-9]+)', 1).cast("double")


def event_rows(spark: SparkSession, sf_dir: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if lo:
        events = events.where(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        events = events.where(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
    return events.withColumn("k", _k(F.col("props")))


def station_hour(spark: SparkSession, sf_dir: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Hourly observation and two models per station, one month, with gaps."""
    return (event_rows(spark, sf_dir, lo, hi)
            .groupBy((F.col("user_id") % STATIONS).alias("station_id"), whole_hour(F.col("ts")).alias("dt"))
            .agg(F.avg("value").alias("obs"), F.avg("k").alias("model_a"),
                 F.avg(0.9 * F.col("value") + 0.1 * F.col("k") + 2).alias("model_b")))


def station_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months and hours, several years."""
    line = table(spark, sf_dir, "lineitem")
    at = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    return (line.groupBy((F.col("l_suppkey") % STATIONS).alias("station_id"), at.cast("timestamp_ntz").alias("dt"))
            .agg(F.avg("l_quantity").alias("obs"),
                 F.avg(0.8 * F.col("l_quantity") + 100 * F.col("l_discount")).alias("model_a"),
                 F.avg(F.col("l_extendedprice") / 2000).alias("model_b")))


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations and altitudes."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("station_id"), F.abs("s_acctbal").alias("altitude"),
        (F.lit(55.05) + (key * 37 % 89) / 100.0).alias("lon"),
        (F.lit(-21.55) + (key * 7 % 83) / 100.0).alias("lat"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10 cells, monthly u, v and p with coordinates."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.groupBy(
        whole_month(F.col("l_shipdate")).alias("time"),
        F.floor(F.col("l_suppkey") % 100 / 10).cast("int").alias("iy"), (F.col("l_suppkey") % 10).cast("int").alias("ix"))
    made = rows.agg(F.avg(F.col("l_quantity") - 25).alias("u"), F.avg(F.col("l_discount") * 100 - 5).alias("v"),
                    F.avg("l_extendedprice").alias("p"))
    return made.withColumns({"lat": F.lit(-21.6) + 0.1 * F.col("iy"), "lon": F.lit(55.0) + 0.1 * F.col("ix")})


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 10 cells, hourly steps."""
    return station_season(spark, sf_dir).select(
        F.col("dt").alias("time"), F.floor(F.col("station_id") / 10).cast("int").alias("iy"),
        (F.col("station_id") % 10).cast("int").alias("ix"), F.col("obs").alias("value"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("dt"),
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
        F.col("l_extendedprice").alias("y"))


def training_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of the whole training table, with a target that the inputs explain; scaled to about one."""
    days = training(spark, sf_dir).groupBy("dt").agg(*[F.avg(c).alias(c) for c in ("x1", "x2", "x3")])
    return days.withColumn("y", F.sin(F.col("x1") / 10) + 4 * F.col("x2") + 10 * F.col("x3") * F.col("x2"))


def regime_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear and cloudy rows in one table."""
    rule = F.when(F.col("event_type").isin("click", "view"), "clear").otherwise("cloudy")
    return (event_rows(spark, sf_dir).groupBy(rule.alias("regime"), whole_hour(F.col("ts")).alias("dt"))
            .agg(F.avg("value").alias("obs"), F.avg("k").alias("model_a")))


# The same views as SQL: name -> (views it needs, text).
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "event_rows": ((), """SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events"""),
    "station_hour": (("event_rows",), """
        SELECT user_id % 40 AS station_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dt, avg(value) AS obs,
               avg(k) AS model_a, avg(0.9 * value + 0.1 * k + 2) AS model_b
        FROM event_rows GROUP BY 1, 2"""),
    "station_season": ((), """
        SELECT l_suppkey % 40 AS station_id, CAST(l_shipdate + to_hours(l_orderkey % 24) AS TIMESTAMP) AS dt,
               avg(l_quantity) AS obs, avg(0.8 * l_quantity + 100 * l_discount) AS model_a,
               avg(l_extendedprice / 2000) AS model_b
        FROM lineitem GROUP BY 1, 2"""),
    "station": ((), """
        SELECT s_suppkey AS station_id, abs(s_acctbal) AS altitude,
               CAST(55.05 AS DOUBLE) + CAST(s_suppkey * 37 % 89 AS DOUBLE) / 100.0 AS lon,
               CAST(-21.55 AS DOUBLE) + CAST(s_suppkey * 7 % 83 AS DOUBLE) / 100.0 AS lat
        FROM supplier"""),
    "grid": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time,
               CAST((l_suppkey % 100) // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix,
               avg(l_quantity - 25) AS u, avg(l_discount * 100 - 5) AS v, avg(l_extendedprice) AS p,
               CAST(-21.6 AS DOUBLE) + CAST(0.1 AS DOUBLE) * ((l_suppkey % 100) // 10) AS lat,
               CAST(55.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (l_suppkey % 10) AS lon
        FROM lineitem GROUP BY 1, 2, 3, 7, 8"""),
    "hourly_grid": (("station_season",), """
        SELECT dt AS time, CAST(station_id // 10 AS INTEGER) AS iy, CAST(station_id % 10 AS INTEGER) AS ix,
               obs AS value FROM station_season"""),
    "training": ((), """
        SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS dt, l_quantity AS x1, l_discount AS x2,
               l_tax AS x3, l_extendedprice AS y FROM lineitem"""),
    "regime_hour": (("event_rows",), """
        SELECT CASE WHEN event_type IN ('click', 'view') THEN 'clear' ELSE 'cloudy' END AS regime,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dt, avg(value) AS obs, avg(k) AS model_a
        FROM event_rows GROUP BY 1, 2"""),
}
