"""Station statistics, verification scores, completeness and station maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.operators import stations as G
from insolara.operators.align import align_subtract
from insolara.operators.filters import exclude_stations, hour_range, station_filter, time_range
from insolara.operators.reshape import first_steps
from insolara.operators.stats import group_variation
from insolara.operators.verify import error_series, forecast_scores, hourly_uncertainty, verify_by_station
from insolara.plans import views as V
from insolara.plans.column_plans import bounds_sql, class_sql
from insolara.plans.filter_plans import SPANS_SQL
from insolara.plans.registry import corr_sql, plan, r, tidy, with_views

SOURCES = ["obs", "model_a", "model_b"]
LO, HI = "2024-01-03 00:00:00", "2024-01-28 23:59:00"

VERIFY_SQL = f"""
    {r('avg(model_b - obs)')} AS mean_bias,
    {r('1 - sum((model_b - obs) * (model_b - obs)) / nullif(count(*) * var_pop(model_b), 0)')} AS r2,
    {r('avg(abs(model_b - obs))')} AS mae, {r('sqrt(avg((model_b - obs) * (model_b - obs)))')} AS rmse,
    {r(corr_sql('model_b', 'obs'))} AS corr"""


@plan("verify_by_station", with_views(f"""
    WITH v AS (
        SELECT station_id, {VERIFY_SQL} FROM station_hour
        WHERE dt >= TIMESTAMP '{LO}' AND dt <= TIMESTAMP '{HI}' AND hour(dt) BETWEEN 8 AND 17
              AND station_id NOT IN (3, 7) GROUP BY 1)
    SELECT v.*, {r('s.lon')} AS lon, {r('s.lat')} AS lat FROM v LEFT JOIN station s ON v.station_id = s.station_id
    """, "station_hour", "station"))
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daytime scores per station with its location; the time bounds reach the event scan."""
    rows = V.station_hour(spark, sf_dir, LO, "2024-01-29 00:00:00")
    rows = exclude_stations(hour_range(time_range(rows, LO, HI)), [3, 7])
    return tidy(G.attach_location(verify_by_station(rows, "model_b", "obs"), V.station(spark, sf_dir)))


@plan("station_mean", with_views(f"""
    SELECT station_id, {r('avg(obs)')} AS obs, {r('avg(model_a)')} AS model_a, {r('avg(model_b)')} AS model_b
    FROM station_hour GROUP BY 1""", "station_hour"))
def station_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.station_mean(V.station_hour(spark, sf_dir), SOURCES))


@plan("timestamp_mean", with_views(f"""
    SELECT dt, {r('avg(obs)')} AS obs, {r('avg(model_a)')} AS model_a, {r('avg(model_b)')} AS model_b
    FROM station_hour GROUP BY 1""", "station_hour"))
def timestamp_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.timestamp_mean(V.station_hour(spark, sf_dir), SOURCES))


@plan("station_month_mean", with_views(f"""
    SELECT CAST(month(dt) AS INTEGER) AS month, station_id, {r('avg(model_b - obs)')} AS bias
    FROM station_season GROUP BY 1, 2""", "station_season"))
def station_month_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir).withColumn("bias", F.col("model_b") - F.col("obs"))
    return tidy(G.station_month_mean(rows, ["bias"]))


@plan("station_hour_mean", with_views(f"""
    SELECT station_id, CAST(hour(dt) AS INTEGER) AS hour, {r('avg(obs)')} AS obs, {r('avg(model_a)')} AS model_a,
           {r('avg(model_b)')} AS model_b
    FROM station_hour WHERE hour(dt) BETWEEN 5 AND 20 GROUP BY 1, 2""", "station_hour"))
def station_hour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.station_hour_mean(hour_range(V.station_hour(spark, sf_dir), 5, 20), SOURCES))


@plan("station_mae", with_views(f"""
    SELECT s.station_id, {r('avg(abs(model_b - obs))')} AS mae, {r('avg(altitude)')} AS altitude
    FROM station_hour s LEFT JOIN station t ON s.station_id = t.station_id
    WHERE hour(dt) BETWEEN 5 AND 20 GROUP BY 1""", "station_hour", "station"))
def station_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hour_range(V.station_hour(spark, sf_dir), 5, 20)
    made = G.station_mae(rows, "model_b", "obs")
    return tidy(G.attach_location(made, V.station(spark, sf_dir), ["altitude"]))


@plan("station_variance", with_views(f"""
    SELECT station_id, min(dt) AS dt, {r('var_pop(obs)')} AS obs, {r('var_pop(model_a)')} AS model_a,
           {r('var_pop(model_b)')} AS model_b
    FROM station_hour WHERE hour(dt) BETWEEN 5 AND 20 GROUP BY 1""", "station_hour"))
def station_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.station_variance(hour_range(V.station_hour(spark, sf_dir), 5, 20), SOURCES))


@plan("attach_location", with_views(f"""
    WITH m AS (SELECT station_id, avg(obs) AS obs FROM station_hour GROUP BY 1)
    SELECT m.station_id, {r('obs')} AS obs, {r('lon')} AS lon, {r('lat')} AS lat
    FROM m LEFT JOIN station s ON m.station_id = s.station_id""", "station_hour", "station"))
def attach_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = G.station_mean(V.station_hour(spark, sf_dir), ["obs"])
    return tidy(G.attach_location(means, V.station(spark, sf_dir)))


@plan("record_counts", with_views("SELECT station_id, " + ", ".join(
    f"count(*) FILTER (hour(dt) = {h}) AS h{h}" for h in range(24)) + " FROM station_hour GROUP BY 1", "station_hour"))
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.record_counts(V.station_hour(spark, sf_dir))


@plan("record_counts_by_hour", with_views("SELECT CAST(hour(dt) AS INTEGER) AS hour, " + ", ".join(
    f"count(*) FILTER (station_id = {s}) AS s{s}" for s in range(V.STATIONS)) + " FROM station_hour GROUP BY 1",
    "station_hour"))
def record_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.record_counts_by_hour(V.station_hour(spark, sf_dir), range(V.STATIONS))


MISSING_SQL = f"""
    WITH {SPANS_SQL},
    ids AS (SELECT DISTINCT station_id FROM station_hour),
    slots AS (SELECT e.year, e.month, i.station_id, e.dt FROM expected e, ids i),
    missing AS (SELECT * FROM slots s WHERE NOT EXISTS (
        SELECT 1 FROM station_hour h WHERE h.station_id = s.station_id AND h.dt = s.dt))"""


@plan("missing_steps", with_views(f"{MISSING_SQL} SELECT year, month, station_id, dt FROM missing", "station_hour"))
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_steps(V.station_hour(spark, sf_dir))


@plan("completeness", with_views(f"""
    {MISSING_SQL},
    want AS (SELECT year, month, station_id, count(*) AS expected FROM slots GROUP BY 1, 2, 3),
    lack AS (SELECT year, month, station_id, count(*) AS missing FROM missing GROUP BY 1, 2, 3),
    days AS (SELECT CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month, station_id,
                    count(DISTINCT day(dt)) AS days FROM station_hour GROUP BY 1, 2, 3)
    SELECT w.year, w.month, w.station_id, expected, expected - coalesce(missing, 0) AS present,
           coalesce(missing, 0) AS missing, coalesce(missing, 0) = 0 AS complete, coalesce(days, 0) AS days
    FROM want w LEFT JOIN lack l ON w.year = l.year AND w.month = l.month AND w.station_id = l.station_id
         LEFT JOIN days d ON w.year = d.year AND w.month = d.month AND w.station_id = d.station_id
    """, "station_hour"))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.completeness(V.station_hour(spark, sf_dir))


@plan("missing_map", with_views(f"""
    {MISSING_SQL},
    places AS (SELECT dt, row_number() OVER (PARTITION BY year, month ORDER BY dt) - 1 AS position FROM expected)
    SELECT m.year, m.month, m.station_id, m.dt, p.position FROM missing m JOIN places p ON m.dt = p.dt
    """, "station_hour"))
def missing_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_map(V.station_hour(spark, sf_dir))


@plan("month_day_count", with_views("""
    SELECT station_id, CAST(month(dt) AS INTEGER) AS month, count(DISTINCT day(dt)) AS days
    FROM station_season GROUP BY 1, 2""", "station_season"))
def month_day_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.month_day_count(V.station_season(spark, sf_dir), ["station_id"])


@plan("distinct_values", with_views("""
    SELECT DISTINCT station_id, CAST(dt AS DATE) AS day FROM station_hour""", "station_hour"))
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir).withColumn("day", F.to_date("dt"))
    return G.distinct_values(rows, "station_id", "day")


def _edge_class(value: str, n: int = 10) -> str:
    return (f"CAST(least(greatest(floor(({value} - vmin) / nullif(vmax - vmin, 0) * {float(n)}) + 1, 1), {n}) "
            "AS INTEGER)")


@plan("station_map", with_views(f"""
    WITH m AS (SELECT station_id, avg(obs) AS obs FROM station_hour GROUP BY 1),
         b AS (SELECT lo AS vmin, hi AS vmax FROM (SELECT {bounds_sql('obs')} FROM m))
    SELECT m.station_id, {r('obs')} AS obs, {r('vmin', 3)} AS vmin, {r('vmax', 3)} AS vmax,
           {_edge_class('obs')} AS class, {r('lon')} AS lon, {r('lat')} AS lat
    FROM m CROSS JOIN b LEFT JOIN station s ON m.station_id = s.station_id""", "station_hour", "station"))
def station_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = G.station_mean(V.station_hour(spark, sf_dir), ["obs"])
    made = G.station_map(means, "obs")
    return tidy(G.attach_location(made, V.station(spark, sf_dir)), vmin=3, vmax=3)


@plan("station_map_month", with_views(f"""
    WITH m AS (SELECT CAST(month(dt) AS INTEGER) AS month, station_id, avg(model_b - obs) AS bias
               FROM station_season GROUP BY 1, 2)
    SELECT m.station_id, m.month, {r('bias')} AS bias, {class_sql('bias', -340.0, 340.0, 10)} AS class,
           {r('lon')} AS lon, {r('lat')} AS lat
    FROM m LEFT JOIN station s ON m.station_id = s.station_id""", "station_season", "station"))
def station_map_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.station_map_month(V.station_season(spark, sf_dir), "model_b", "obs", V.station(spark, sf_dir)))


@plan("station_hour_curves", with_views(f"""
    WITH m AS (SELECT station_id, CAST(hour(dt) AS INTEGER) AS hour, avg(model_b) - avg(obs) AS bias
               FROM station_hour WHERE hour(dt) BETWEEN 5 AND 20 GROUP BY 1, 2)
    SELECT m.station_id, hour, {r('bias')} AS bias, {r('altitude')} AS altitude
    FROM m LEFT JOIN station s ON m.station_id = s.station_id""", "station_hour", "station"))
def station_hour_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hour_range(V.station_hour(spark, sf_dir), 5, 20)
    return tidy(G.station_hour_curves(rows, "model_b", "obs", V.station(spark, sf_dir)))


@plan("altitude_variance", with_views(f"""
    WITH m AS (SELECT station_id, var_pop(obs) AS obs, var_pop(model_a) AS model_a, var_pop(model_b) AS model_b
               FROM station_hour WHERE hour(dt) BETWEEN 5 AND 20 GROUP BY 1)
    SELECT m.station_id, {r('obs')} AS obs, {r('model_a')} AS model_a, {r('model_b')} AS model_b,
           {r('model_b - obs')} AS bias, {r('altitude')} AS altitude
    FROM m LEFT JOIN station s ON m.station_id = s.station_id""", "station_hour", "station"))
def altitude_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hour_range(V.station_hour(spark, sf_dir), 5, 20)
    return tidy(G.altitude_variance(rows, SOURCES, "model_b", "obs", V.station(spark, sf_dir)))


@plan("version_diff", with_views(f"""
    WITH m AS (SELECT station_id, avg(model_a) AS model_a, avg(model_b) AS model_b FROM station_hour GROUP BY 1)
    SELECT m.station_id, {r('model_a')} AS model_a, {r('model_b')} AS model_b, {r('model_a - model_b')} AS diff,
           {r('abs(model_a - model_b)')} AS abs_diff, {r('lon')} AS lon, {r('lat')} AS lat, {r('altitude')} AS altitude
    FROM m LEFT JOIN station s ON m.station_id = s.station_id""", "station_hour", "station"))
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.version_diff(V.station_hour(spark, sf_dir), "model_a", "model_b", V.station(spark, sf_dir)))


@plan("xy_pairs", with_views(f"""
    SELECT s.station_id, {r('max(altitude)')} AS x, {r('avg(obs)')} AS y
    FROM station_hour h JOIN station s ON h.station_id = s.station_id GROUP BY 1""", "station_hour", "station"))
def xy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.xy_pairs(V.station_hour(spark, sf_dir), "obs", V.station(spark, sf_dir)))


@plan("month_curves", with_views(f"""
    WITH m AS (SELECT dt, avg(obs) AS obs, avg(model_b) AS model_b FROM station_hour GROUP BY 1),
         p AS (SELECT *, CAST(month(dt) AS INTEGER) AS month,
                      row_number() OVER (PARTITION BY month(dt) ORDER BY dt) - 1 AS position FROM m)
    SELECT month, position, CAST(day(dt) AS INTEGER) AS day, 'obs' AS source, {r('obs')} AS value FROM p
    UNION ALL SELECT month, position, CAST(day(dt) AS INTEGER), 'model_b', {r('model_b')} FROM p""", "station_hour"))
def month_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.month_curves(V.station_hour(spark, sf_dir), ["obs", "model_b"]))


@plan("group_variation", with_views(f"""
    WITH g AS (SELECT CAST(month(dt) AS VARCHAR) AS "group", var_samp(obs) AS var_obs, var_samp(model_b) AS var_model_b,
                      avg(obs) AS mean_obs, avg(model_b) AS mean_model_b FROM station_season GROUP BY 1)
    SELECT "group", {r('var_obs')} AS var_obs, {r('var_model_b')} AS var_model_b, {r('mean_obs')} AS mean_obs,
           {r('mean_model_b')} AS mean_model_b FROM g
    UNION ALL SELECT 'overall', {r('avg(var_obs)')}, {r('avg(var_model_b)')}, {r('avg(mean_obs)')},
           {r('avg(mean_model_b)')} FROM g""", "station_season"))
def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir).withColumn("month", F.month("dt"))
    return tidy(group_variation(rows, ["obs", "model_b"], "month"))


def scores_sql(p: str, o: str) -> str:
    spread = f"nullif(max({o}) - min({o}), 0)"
    rmse = f"sqrt(avg(({p} - {o}) * ({p} - {o})))"
    mae = f"avg(abs({p} - {o}))"
    return f"""count(*) AS n, {r(rmse)} AS rmse, {r(mae)} AS mae, {r(f'{rmse} / {spread} * 100')} AS nrmse,
        {r(f'{mae} / {spread} * 100')} AS nmae, {r(f'avg(abs({p} - {o}) / nullif({o}, 0)) * 100', 4)} AS mape,
        {r(f'avg(CASE WHEN abs({o} - {p}) <= {o} * 0.05 THEN 1.0 ELSE 0.0 END)')} AS hit5,
        {r(f'avg(CASE WHEN abs({o} - {p}) <= {o} * 0.08 THEN 1.0 ELSE 0.0 END)')} AS hit8"""


@plan("forecast_scores", with_views(f"""
    SELECT {scores_sql('model_b', 'obs')} FROM station_hour""", "station_hour"))
def scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(forecast_scores(V.station_hour(spark, sf_dir), "model_b", "obs"), mape=4)


@plan("forecast_scores_first_day", with_views(f"""
    SELECT {scores_sql('model_b', 'obs')}
    FROM (SELECT * FROM station_hour WHERE station_id = 3 ORDER BY dt LIMIT 24)""", "station_hour"))
def scores_first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily report of one station: its first 24 steps."""
    rows = first_steps(station_filter(V.station_hour(spark, sf_dir), 3))
    return tidy(forecast_scores(rows, "model_b", "obs"), mape=4)


@plan("forecast_scores_by_station", with_views(f"""
    SELECT station_id, {scores_sql('model_b', 'obs')} FROM station_hour GROUP BY 1""", "station_hour"))
def scores_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(forecast_scores(V.station_hour(spark, sf_dir), "model_b", "obs", ["station_id"]), mape=4)


@plan("hourly_uncertainty", with_views(f"""
    WITH h AS (SELECT CAST(hour(dt) AS INTEGER) AS hour, avg(obs) AS mean_obs, avg(model_b) AS mean_pred,
                      avg(abs(model_b - obs)) AS mae, abs(avg(model_b) - avg(obs)) AS mean_error
               FROM station_hour GROUP BY 1)
    SELECT hour, {r('mean_obs')} AS mean_obs, {r('mean_pred')} AS mean_pred, {r('mae')} AS mae,
           {r('mean_error')} AS mean_error, {r('(SELECT avg(mean_error) FROM h)')} AS overall_error,
           (SELECT count(DISTINCT CAST(dt AS DATE)) FROM station_hour) AS days FROM h""", "station_hour"))
def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(hourly_uncertainty(V.station_hour(spark, sf_dir), "model_b", "obs"))


ERROR_SERIES_SQL = """
    WITH m AS (SELECT dt, avg(obs) AS obs, avg(model_b) AS pred FROM station_hour GROUP BY 1),
         p AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS position FROM m)"""


@plan("error_series", with_views(f"""
    {ERROR_SERIES_SQL} SELECT position, {r('obs')} AS obs, {r('pred')} AS pred FROM p""", "station_hour"))
def series_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = G.timestamp_mean(V.station_hour(spark, sf_dir), ["obs", "model_b"])
    return tidy(error_series(means, "model_b", "obs"))


@plan("error_series_first_day", with_views(f"""
    {ERROR_SERIES_SQL} SELECT position, {r('obs')} AS obs, {r('pred')} AS pred FROM p WHERE position < 24""",
                                           "station_hour"))
def first_day_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = G.timestamp_mean(V.station_hour(spark, sf_dir), ["obs", "model_b"])
    return tidy(error_series(means, "model_b", "obs", first_day=True))


@plan("align_subtract", with_views(f"""
    WITH m AS (SELECT dt, avg(model_b) AS pred FROM station_hour GROUP BY 1),
         o AS (SELECT dt, avg(obs) AS obs FROM regime_hour WHERE regime = 'clear' GROUP BY 1)
    SELECT m.dt, {r('pred')} AS pred, {r('obs')} AS obs, {r('pred - obs')} AS error FROM m JOIN o ON m.dt = o.dt
    """, "station_hour", "regime_hour"))
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = V.station_hour(spark, sf_dir).groupBy("dt").agg(F.avg("model_b").alias("value"))
    observed = (V.regime_hour(spark, sf_dir).where(F.col("regime") == "clear")
                .groupBy("dt").agg(F.avg("obs").alias("value")))
    return tidy(align_subtract(predicted, observed))
