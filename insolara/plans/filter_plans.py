"""Row filters, generated calendars and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions.nulls import drop_incomplete, inf_to_null
from insolara.operators import calendar as K
from insolara.operators import filters as D
from insolara.operators import reshape as H
from insolara.plans import views as V
from insolara.plans.registry import plan, r, tidy, with_views

LO, HI = "2024-01-05 00:00:00", "2024-01-20 23:59:00"


@plan("time_range", f"""
    SELECT event_id, ts, value FROM events
    WHERE ts >= TIMESTAMP '{LO}' AND ts <= TIMESTAMP '{HI}'""")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.time_range(V.table(spark, sf_dir, "events"), LO, HI, "ts").select("event_id", "ts", "value")


@plan("hour_range", """
    SELECT event_id, ts, value FROM events WHERE hour(ts) BETWEEN 8 AND 17""")
def hour_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hour_range(V.table(spark, sf_dir, "events"), dt="ts").select("event_id", "ts", "value")


@plan("exclude_stations", with_views("""
    SELECT station_id, count(*) AS n FROM station_hour WHERE station_id NOT IN (3, 7) GROUP BY 1""", "station_hour"))
def exclude_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.exclude_stations(V.station_hour(spark, sf_dir), [3, 7])
    return kept.groupBy("station_id").agg(F.count("*").alias("n"))


@plan("station_filter", with_views(f"""
    SELECT dt, {r('obs')} AS obs FROM station_hour WHERE station_id = 5""", "station_hour"))
def station_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.station_filter(V.station_hour(spark, sf_dir), 5).select("dt", "obs"))


@plan("month_slice", with_views(f"""
    SELECT CAST(month(dt) AS INTEGER) AS month, count(*) AS n, {r('avg(obs)')} AS obs FROM station_season
    WHERE month(dt) IN (11, 12, 1, 2, 3, 4) GROUP BY 1""", "station_season"))
def month_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.month_slice(V.station_season(spark, sf_dir))
    return tidy(rows.groupBy("month").agg(F.count("*").alias("n"), F.avg("obs").alias("obs")))


@plan("season_slice", with_views(f"""
    SELECT CAST((month(dt) % 12 + 3) // 3 AS INTEGER) AS season, count(*) AS n, {r('avg(obs)')} AS obs
    FROM station_season WHERE (month(dt) % 12 + 3) // 3 IN (1, 3) GROUP BY 1""", "station_season"))
def season_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.season_slice(V.station_season(spark, sf_dir), (1, 3))
    return tidy(rows.groupBy("season").agg(F.count("*").alias("n"), F.avg("obs").alias("obs")))


@plan("block_slice", with_views(f"""
    SELECT CASE WHEN month(dt) IN (2, 3, 4) THEN '020304' ELSE '080910' END AS training_block, count(*) AS n,
           {r('avg(x1)')} AS x1 FROM training WHERE month(dt) IN (2, 3, 4, 8, 9, 10) GROUP BY 1""", "training"))
def block_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.block_slice(V.training(spark, sf_dir), ("020304", "080910"))
    return tidy(rows.groupBy("training_block").agg(F.count("*").alias("n"), F.avg("x1").alias("x1")))


@plan("drop_incomplete", """
    SELECT event_id, value FROM events WHERE user_id % 7 <> 0 AND user_id % 5 <> 0 AND user_id % 3 <> 0""")
def incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    value = (F.when(user % 7 == 0, F.lit(None)).when(user % 5 == 0, F.lit(float("nan")))
             .when(user % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return drop_incomplete(V.table(spark, sf_dir, "events").select("event_id", value.cast("double").alias("value")))


@plan("inf_to_null", """
    SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN value END AS value FROM events""")
def infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("user_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return V.table(spark, sf_dir, "events").select("event_id", inf_to_null(value).alias("value"))


@plan("bbox", with_views("""
    SELECT station_id, lon, lat FROM station WHERE lon BETWEEN 55 AND 56 AND lat BETWEEN -21.5 AND -20.8""", "station"))
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bbox(V.station(spark, sf_dir), "reu").select("station_id", "lon", "lat")


@plan("around", with_views("""
    SELECT station_id, lon, lat FROM station
    WHERE lon BETWEEN 55.4::DOUBLE - 0.15::DOUBLE AND 55.4::DOUBLE + 0.15::DOUBLE
          AND lat BETWEEN -21.1::DOUBLE - 0.15::DOUBLE AND -21.1::DOUBLE + 0.15::DOUBLE""", "station"))
def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.around(V.station(spark, sf_dir), 55.4, -21.1, 0.3).select("station_id", "lon", "lat")


@plan("stride", with_views(f"""
    SELECT time, iy, ix, {r('u')} AS u FROM grid WHERE iy % 2 = 0 AND ix % 2 = 0""", "grid"))
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.stride(V.grid(spark, sf_dir), 2).select("time", "iy", "ix", "u"))


@plan("at_time", with_views(f"""
    SELECT time, iy, ix, {r('u')} AS u FROM grid
    WHERE time IN (TIMESTAMP '1995-11-01', TIMESTAMP '1995-12-01')""", "grid"))
def at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.at_time(V.grid(spark, sf_dir), ["1995-11-01", "1995-12-01"]).select("time", "iy", "ix", "u"))


@plan("at_hour", with_views("""
    SELECT iy, ix, count(*) AS n FROM hourly_grid WHERE hour(time) = 12 GROUP BY 1, 2""", "hourly_grid"))
def at_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.at_hour(V.hourly_grid(spark, sf_dir), [12]).groupBy("iy", "ix").agg(F.count("*").alias("n"))


@plan("regime_split", f"""
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'clear' ELSE 'cloudy' END AS regime,
           count(*) AS n, {r('avg(value)')} AS value FROM events GROUP BY 1""")
def regime_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.regime_rows(V.table(spark, sf_dir, "events"), F.col("event_type").isin("click", "view"))
    return tidy(rows.groupBy("regime").agg(F.count("*").alias("n"), F.avg("value").alias("value")))


@plan("cluster_filter", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cluster_filter(V.table(spark, sf_dir, "embeddings"), 3, "label").select("vec_id", "label")


@plan("expand_days", """
    SELECT DISTINCT d + to_hours(CAST(12 * i AS BIGINT)) AS dt
    FROM (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS d FROM orders), range(0, 4) AS t(i)""")
def expand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.expand_days(V.table(spark, sf_dir, "orders"), "o_orderdate", "12 hours", 4)


@plan("step_times", with_views("""
    WITH s AS (SELECT station_id, min(dt) AS first, count(*) AS n FROM station_hour GROUP BY 1)
    SELECT station_id, unnest(generate_series(first, first + to_hours(n - 1), INTERVAL 1 HOUR)) AS dt FROM s
    """, "station_hour"))
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.station_hour(spark, sf_dir).groupBy("station_id").agg(F.min("dt").alias("first"), F.count("*").alias("n"))
    return K.step_times(counts, "first", "n", ["station_id"])


SPANS_SQL = """
    spans AS (SELECT CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month, min(dt) AS lo,
                     max(dt) AS hi FROM station_hour GROUP BY 1, 2),
    steps AS (SELECT year, month, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS dt FROM spans),
    expected AS (SELECT * FROM steps WHERE hour(dt) BETWEEN 8 AND 17)"""


@plan("daytime_calendar", with_views(f"WITH {SPANS_SQL} SELECT year, month, dt FROM expected", "station_hour"))
def daytime_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daytime_calendar(V.station_hour(spark, sf_dir))


@plan("step_position", with_views("""
    SELECT month, dt, row_number() OVER (PARTITION BY month ORDER BY dt) - 1 AS position
    FROM (SELECT DISTINCT CAST(month(dt) AS INTEGER) AS month, dt FROM station_season)""", "station_season"))
def step_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir).select(F.month("dt").alias("month"), "dt")
    return H.step_position(rows, "dt", ["month"])


@plan("contiguous_prefix", with_views("""
    WITH f AS (SELECT station_id, dt, min(dt) OVER (PARTITION BY station_id) AS first FROM station_hour),
         o AS (SELECT station_id, dt, date_diff('hour', first, dt) AS ahead,
                      row_number() OVER (PARTITION BY station_id ORDER BY dt) - 1 AS place FROM f)
    SELECT station_id, dt FROM o WHERE ahead = place AND ahead < 24""", "station_hour"))
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.contiguous_prefix(V.station_hour(spark, sf_dir).select("station_id", "dt"), by=["station_id"])


@plan("keep_first", """
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
    WHERE rn = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return H.keep_first(rows, ["user_id", "event_type"], ["event_id"])


@plan("sort_time", with_views(f"""
    SELECT dt, station_id, {r('obs')} AS obs FROM station_hour ORDER BY dt, station_id""", "station_hour"))
def sort_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sort_time(tidy(V.station_hour(spark, sf_dir).select("dt", "station_id", "obs")), "dt", "station_id")


@plan("sort_desc", with_views(f"""
    SELECT station_id, {r('avg(obs)')} AS obs FROM station_hour GROUP BY 1 ORDER BY 2 DESC""", "station_hour"))
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.station_hour(spark, sf_dir).groupBy("station_id").agg(F.avg("obs").alias("obs"))
    return H.sort_desc(tidy(means), "obs")


@plan("arg_best", f"""
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
    WHERE rn = 1""")
def arg_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.arg_best(V.table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], ["o_custkey"])


@plan("above_best", f"""
    SELECT o_orderkey, {r('o_totalprice - (SELECT min(o_totalprice) FROM orders)', 3)} AS delta FROM orders""")
def above_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.above_best(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return tidy(rows.select("o_orderkey", "delta"), 3)


@plan("head", with_views(f"""
    SELECT dt, {r('avg(obs)')} AS obs FROM station_hour GROUP BY 1 ORDER BY 1 LIMIT 24""", "station_hour"))
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.station_hour(spark, sf_dir).groupBy("dt").agg(F.avg("obs").alias("obs"))
    return tidy(H.first_steps(means))


@plan("stack", with_views(f"""
    SELECT station_id, dt, 'model_a' AS source, {r('model_a')} AS value FROM station_hour
    UNION ALL SELECT station_id, dt, 'model_b', {r('model_b')} FROM station_hour""", "station_hour"))
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    parts = [rows.select("station_id", "dt", F.lit(c).alias("source"), F.col(c).alias("value"))
             for c in ("model_a", "model_b")]
    return tidy(H.stack(*parts))


@plan("difference", """
    SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (
        SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    return H.difference(orders, orders.where(F.col("o_orderpriority") == "1-URGENT"), ["o_custkey"])


@plan("melt", with_views(f"""
    SELECT station_id, dt, var, {r('value')} AS value
    FROM (SELECT station_id, dt, obs, model_a, model_b FROM station_hour)
    UNPIVOT INCLUDE NULLS (value FOR var IN (obs, model_a, model_b))""", "station_hour"))
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(H.melt(V.station_hour(spark, sf_dir), ["station_id", "dt"], ["obs", "model_a", "model_b"]))


def hours_sql(value: str) -> str:
    return ", ".join(f"{r(f'avg(CASE WHEN hour(dt) = {h} THEN {value} END)')} AS h{h}" for h in H.DAYTIME)


@plan("pivot_hours", with_views(f"""
    SELECT station_id, {hours_sql('obs')} FROM station_hour WHERE hour(dt) BETWEEN 8 AND 17 GROUP BY 1""",
                                "station_hour"))
def pivot_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(H.pivot_hours(V.station_hour(spark, sf_dir), "station_id", "obs"))


@plan("profile_vector", with_views(f"""
    WITH p AS (SELECT station_id, hour(dt) AS hour, avg(obs) AS v FROM station_hour
               WHERE hour(dt) BETWEEN 8 AND 17 GROUP BY 1, 2)
    SELECT p.station_id, CAST(hour - 8 AS INTEGER) AS place, {r('v')} AS value, n = 10 AS complete
    FROM p JOIN (SELECT station_id, count(*) AS n FROM p GROUP BY 1) c ON p.station_id = c.station_id
    """, "station_hour"))
def profile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = H.profile_vector(V.station_hour(spark, sf_dir), "station_id", "obs")
    flat = made.select("station_id", "complete", F.posexplode("profile").alias("place", "value"))
    return tidy(flat.where(F.col("value").isNotNull()))


@plan("rename_project", with_views(f"""
    SELECT station_id, dt, {r('model_b')} AS ssr_new, {r('obs')} AS ssr FROM station_hour""", "station_hour"))
def rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return tidy(rows.select("station_id", "dt", F.col("model_b").alias("ssr_new"), F.col("obs").alias("ssr")))


@plan("bounds", with_views(f"""
    SELECT {r('min(obs)')} AS low, {r('max(obs)')} AS high, {r('max(obs) - min(obs)')} AS spread FROM station_hour""",
                           "station_hour"))
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return tidy(rows.agg(F.min("obs").alias("low"), F.max("obs").alias("high"),
                         C.bias(F.max("obs"), F.min("obs")).alias("spread")))
