"""Sources and sinks: text round trips through the scratch folder, releases and line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insolara.functions.timecol import whole_hour
from insolara.operators.stats import Scaler, scaler_fit
from insolara.plans import views as V
from insolara.plans.registry import plan, r, tidy, with_views
from insolara.session import scratch_path
from insolara.sinks.models import save_scaler
from insolara.sinks.text import line_protocol, series_lines, write_csv, write_parquet, write_series_csv
from insolara.sources.models import load_scaler
from insolara.sources.releases import FILE_FORMAT, forecast_release
from insolara.sources.stations import read_stations
from insolara.sources.tables import station_query
from insolara.sources.training import read_training
from insolara.streaming.releases import first_run, stream_first_runs, told_hours


@plan("station_query", """
    SELECT user_id AS station_id, ts AS dt, value AS ssr FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 23:59:00' AND user_id NOT IN (3, 7)""")
def query_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    window = (at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at <= F.lit("2024-01-20 23:59:00").cast("timestamp_ntz"))
    columns = {"station_id": "user_id", "dt": "ts", "ssr": "value"}
    return station_query(spark, f"{sf_dir}/events.parquet", columns, window, [3, 7])


TRAINING_FILE = T.StructType([
    T.StructField("DateTime", T.StringType()), T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("x1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()), T.StructField("y", T.DoubleType()),
])


@plan("read_training", with_views(f"""
    SELECT dt, l_orderkey, l_linenumber, x1, x2, y, CAST(month(dt) AS INTEGER) AS month,
           CAST((month(dt) % 12 + 3) // 3 AS INTEGER) AS season
    FROM training WHERE l_linenumber NOT IN (3, 5)""", "training"))
def training_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table as a day-first text file with sentinels, read back with features."""
    line = F.col("l_linenumber")
    rows = V.training(spark, sf_dir).select(
        F.date_format("dt", "dd/MM/yyyy HH:mm").alias("DateTime"), "l_orderkey", "l_linenumber",
        F.when(line == 3, F.lit("-99999")).otherwise(F.col("x1").cast("string")).alias("x1"),
        F.when(line == 5, F.lit("-99999.0")).otherwise(F.col("x2").cast("string")).alias("x2"), "y")
    path = scratch_path(spark, "training")
    write_csv(rows, path)
    return read_training(spark, path, TRAINING_FILE, ["l_orderkey", "l_linenumber", "x1", "x2", "y", "month", "season"])


@plan("read_stations", with_views("""
    SELECT station_id, CAST('station-' || CAST(station_id AS VARCHAR) AS VARCHAR) AS name, lat, lon,
           CAST(NULL AS DOUBLE) AS altitude FROM station""", "station"))
def station_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station table as a catalog with anonymous columns, read back by position."""
    name = F.concat(F.lit("station-"), F.col("station_id").cast("string"))
    rows = V.station(spark, sf_dir).select("station_id", name.alias("name"), "lat", "lon")
    path = scratch_path(spark, "stations")
    write_csv(rows, path)
    return read_stations(spark, path, "model_old")


RELEASE_SQL = """
    files AS (SELECT ts AS modified, 1 + user_id % 3 AS release, date_trunc('hour', ts) AS dt,
                     280 + round(value, 2) AS kelvin FROM events),
    moment AS (SELECT min(date_trunc('hour', ts)) AS start FROM events),
    newest AS (SELECT release FROM files ORDER BY modified DESC, release DESC LIMIT 1),
    hours AS (SELECT f.release, f.dt, arg_max(f.kelvin, (f.modified, f.kelvin)) AS kelvin
              FROM files f JOIN newest n ON f.release = n.release GROUP BY 1, 2),
    ahead AS (SELECT h.*, date_diff('hour', m.start, h.dt) AS step,
                     row_number() OVER (ORDER BY h.dt) - 1 AS place FROM hours h, moment m)"""


@plan("forecast_release", f"""
    WITH {RELEASE_SQL}
    SELECT release, CAST(dt AS TIMESTAMP) AS dt, round_even(kelvin - 273.5, 3) + 0.0 AS temp
    FROM ahead WHERE step = place AND step < 24""")
def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a release file: the newest release from the first hour to its first gap."""
    events = V.table(spark, sf_dir, "events")
    hour = F.date_format("ts", "yyyyMMddHH")
    body = F.concat(F.repeat(F.lit("x\n"), 10), (F.lit(280.0) + F.round("value", 2)).cast("string"), F.lit("\ny"))
    name = F.format_string("/releases/" + FILE_FORMAT.format(hour="%s", release="%d"), hour, F.col("user_id") % 3 + 1)
    files = events.select(name.alias("path"), F.col("ts").alias("modified"), body.alias("content"))
    start = events.agg(F.min("ts")).scalar()
    made = forecast_release(files, start)
    return made.withColumn("temp", F.col("temp") + 0.0)


@plan("stream_first_runs", """
    WITH files AS (SELECT ts AS modified, 1 + user_id % 3 AS release, date_trunc('hour', ts) AS dt, 280 + round(value, 2) AS kelvin
                   FROM events),
    hours AS (SELECT release, date_diff('hour', TIMESTAMP '2024-01-01', dt) AS step, dt,
                     arg_max(kelvin, (modified, kelvin)) AS kelvin FROM files GROUP BY 1, 2, 3),
    ahead AS (SELECT *, row_number() OVER (PARTITION BY release ORDER BY step) - 1 AS place FROM hours WHERE step BETWEEN 0 AND 239)
    SELECT 'temp_forecast,release=' || release || ' date_concerned="' || strftime(dt, '%Y-%m-%d %H:%M:%S') || '",temp='
           || printf('%.3f', round_even(kelvin - 273.5, 3)) || ' ' || CAST(CAST(epoch_us(dt) * 1000 AS BIGINT) AS VARCHAR) AS line
    FROM ahead WHERE step = place""")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a release file that a stream reads; what it has told of all releases, as line protocol."""
    arrived = V.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3 + 1).alias("release"), whole_hour(F.col("ts")).alias("dt"),
        (F.lit(280.0) + F.round("value", 2)).alias("kelvin"), F.col("ts").alias("modified"))
    folder = scratch_path(spark, "release-rows")
    arrived.repartition(6, "modified").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = stream_first_runs(first_run(stream, "2024-01-01", 240, late="60 days"), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    told = told_hours(spark, f"{folder}/out", "2024-01-01")
    lines = [line_protocol(told.where(F.col("release") == k), f"temp_forecast,release={k}", "temp", zone="UTC") for k in (1, 2, 3)]
    return lines[0].union(lines[1]).union(lines[2])


@plan("line_protocol", with_views("""
    SELECT 'pv_forecast,site=island date_concerned="' || strftime(dt, '%Y-%m-%d %H:%M:%S') || '",model_a='
           || printf('%.3f', model_a) || ' ' || CAST(CAST(epoch_us(dt - INTERVAL 4 HOUR) * 1000 AS BIGINT) AS VARCHAR)
           AS line FROM station_hour""", "station_hour"))
def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_protocol(V.station_hour(spark, sf_dir), "pv_forecast,site=island", "model_a")


SERIES_SQL = with_views("""
    SELECT CAST(station_id AS VARCHAR) || ',' || strftime(dt, '%Y-%m-%d %H:%M:%S') || ',' || printf('%.4f', model_a)
           AS line FROM station_hour""", "station_hour")


@plan("series_csv", SERIES_SQL)
def series_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_lines(V.station_hour(spark, sf_dir), "model_a")


@plan("write_series_csv", SERIES_SQL)
def series_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one folder, read back."""
    rows = V.station_hour(spark, sf_dir)
    path = scratch_path(spark, "series")
    for odd in (0, 1):
        write_series_csv(rows.where(F.col("station_id") % 2 == odd), path, "model_a")
    return spark.read.text(path).withColumnRenamed("value", "line")


@plan("write_parquet", with_views(f"""
    SELECT CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month, count(*) AS n, {r('avg(x1)')} AS x1
    FROM training WHERE month(dt) IN (11, 12) GROUP BY 1, 2""", "training"))
def parquet_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table by year and month; the month filter prunes folders."""
    path = scratch_path(spark, "training-parquet")
    write_parquet(V.training(spark, sf_dir), path)
    rows = spark.read.parquet(path).where(F.col("month").isin(11, 12))
    return tidy(rows.groupBy("year", "month").agg(F.count("*").alias("n"), F.avg("x1").alias("x1")))


@plan("save_load_scaler", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS name, {r(f'avg({c})')} AS mean, {r(f'stddev_pop({c})')} AS scale FROM training"
    for c in ("x1", "x2", "x3")), "training"))
def scaler_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scaler")
    save_scaler(spark, scaler_fit(V.training(spark, sf_dir), ["x1", "x2", "x3"]), path)
    loaded: Scaler = load_scaler(spark, path)
    rows = list(zip(loaded.columns, loaded.means, loaded.scales))
    return tidy(spark.createDataFrame(rows, "name string, mean double, scale double"))
