"""Joins between sources, times, profiles and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.timecol import whole_hour
from insolara.operators import align as A
from insolara.operators.calendar import expand_days
from insolara.plans import views as V
from insolara.plans.registry import plan, r, tidy, with_views


def _source(spark: SparkSession, sf_dir: str, event_type: str, value: str) -> DataFrame:
    rows = V.event_rows(spark, sf_dir).where(F.col("event_type") == event_type)
    return rows.groupBy((F.col("user_id") % V.STATIONS).alias("station_id"), whole_hour(F.col("ts")).alias("dt")).agg(
        F.avg(value).alias("value"))


def _source_sql(event_type: str, value: str) -> str:
    return (f"SELECT user_id % 40 AS station_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dt, avg({value}) AS value "
            f"FROM event_rows WHERE event_type = '{event_type}' GROUP BY 1, 2")


@plan("align_sources", with_views(f"""
    WITH a AS ({_source_sql('click', 'value')}), b AS ({_source_sql('view', 'k')}), c AS ({_source_sql('error', 'k')}),
         ab AS (SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.dt, b.dt) AS dt,
                       a.value AS click, b.value AS "view"
                FROM a FULL JOIN b ON a.station_id = b.station_id AND a.dt = b.dt)
    SELECT coalesce(ab.station_id, c.station_id) AS station_id, coalesce(ab.dt, c.dt) AS dt, {r('click')} AS click,
           {r('"view"')} AS "view", {r('c.value')} AS error
    FROM ab FULL JOIN c ON ab.station_id = c.station_id AND ab.dt = c.dt""", "event_rows"))
def align_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"click": _source(spark, sf_dir, "click", "value"), "view": _source(spark, sf_dir, "view", "k"),
               "error": _source(spark, sf_dir, "error", "k")}
    return tidy(A.align_sources(sources))


@plan("hour_profile_join", with_views(f"""
    SELECT s.station_id, s.dt, CAST(h.hour AS INTEGER) AS hour, {r('s.obs')} AS obs, {r('h.m')} AS obs_hour_mean
    FROM station_season s JOIN (SELECT hour(dt) AS hour, avg(obs) AS m FROM station_season GROUP BY 1) h
      ON hour(s.dt) = h.hour""", "station_season"))
def hour_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir).select("station_id", "dt", "obs")
    return tidy(A.hour_profile_join(rows, ["obs"]))


@plan("concat_columns", with_views(f"""
    SELECT a.l_orderkey, a.n, {r('a.x1')} AS x1, {r('b.o_totalprice', 2)} AS o_totalprice
    FROM (SELECT l_orderkey, count(*) AS n, avg(x1) AS x1 FROM training GROUP BY 1) a
    JOIN orders b ON a.l_orderkey = b.o_orderkey""", "training"))
def concat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = (V.training(spark, sf_dir).groupBy("l_orderkey")
            .agg(F.count("*").alias("n"), F.avg("x1").alias("x1")))
    right = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return tidy(A.concat_columns(left, right, ["l_orderkey"]), o_totalprice=2)


@plan("attach_cluster", with_views(f"""
    SELECT h.station_id, l.label AS cluster, count(*) AS n, {r('avg(obs)')} AS obs
    FROM station_hour h JOIN embeddings l ON h.station_id = l.vec_id GROUP BY 1, 2""", "station_hour"))
def attach_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.station_hour(spark, sf_dir).groupBy("station_id").agg(
        F.count("*").alias("n"), F.avg("obs").alias("obs"))
    labels = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("station_id"), F.col("label").alias("cluster"))
    return tidy(A.attach_cluster(means, labels))


@plan("select_times", with_views(f"""
    SELECT station_id, dt, {r('obs')} AS obs FROM station_hour WHERE dt IN (
        SELECT d + to_hours(CAST(6 * i AS BIGINT))
        FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events), range(0, 4) AS t(i))""", "station_hour"))
def select_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = V.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return tidy(A.select_times(V.station_hour(spark, sf_dir), expand_days(days, "day", "6 hours", 4))
                .select("station_id", "dt", "obs"))


@plan("select_month_days", with_views(f"""
    SELECT station_id, dt, {r('obs')} AS obs FROM station_season WHERE month(dt) IN (7, 1, 2, 3) AND day(dt) IN (1, 20)
    """, "station_season"))
def select_month_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.select_month_days(V.station_season(spark, sf_dir), [7, 1, 2, 3], [1, 20])
    return tidy(rows.select("station_id", "dt", "obs"))
