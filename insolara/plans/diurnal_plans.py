"""Diurnal cycles, correlations by group, distributions and scatter data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions import solar
from insolara.operators import diurnal as G
from insolara.operators.filters import SEASON_MONTHS
from insolara.operators.quantiles import box_stats
from insolara.operators.verify import error_columns
from insolara.plans import views as V
from insolara.plans.column_plans import SEASON_SQL
from insolara.plans.registry import corr_sql, plan, r, tidy, with_views


@plan("hour_mean", with_views(f"""
    SELECT CAST(hour(dt) AS INTEGER) AS hour, {r('avg(obs)')} AS obs, {r('avg(model_b)')} AS model_b
    FROM station_season GROUP BY 1""", "station_season"))
def hour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.hour_mean(V.station_season(spark, sf_dir), ["obs", "model_b"]))


def _scaled_sql(c: str) -> str:
    return f"""
        SELECT h.regime, h.hour, '{c}' AS var, {r(f'h.{c} / t.{c}')} AS value
        FROM (SELECT regime, CAST(hour(dt) AS INTEGER) AS hour, avg({c}) AS {c} FROM regime_hour GROUP BY 1, 2) h
        JOIN (SELECT regime, max({c}) AS {c} FROM regime_hour GROUP BY 1) t ON h.regime = t.regime"""


@plan("hour_mean_scaled", with_views(f"{_scaled_sql('obs')} UNION ALL {_scaled_sql('model_a')}", "regime_hour"))
def hour_mean_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.hour_mean_scaled(V.regime_hour(spark, sf_dir), ["obs", "model_a"]))


def _hour_by_sql(c: str, key: str, name: str) -> str:
    return (f"SELECT {key} AS {name}, CAST(hour(dt) AS INTEGER) AS hour, '{c}' AS var, {r(f'avg({c})')} AS value "
            "FROM station_season GROUP BY 1, 2")


MONTH_SQL = "CAST(month(dt) AS INTEGER)"


@plan("hour_mean_by", with_views(
    f"{_hour_by_sql('obs', MONTH_SQL, 'month')} UNION ALL {_hour_by_sql('model_b', MONTH_SQL, 'month')}",
    "station_season"))
def hour_mean_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.hour_mean_by(V.station_season(spark, sf_dir), ["obs", "model_b"], "month"))


@plan("hour_mean_by_season", with_views(
    f"{_hour_by_sql('obs', SEASON_SQL, 'season')} UNION ALL {_hour_by_sql('model_b', SEASON_SQL, 'season')}",
    "station_season"))
def hour_mean_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.hour_mean_by(V.station_season(spark, sf_dir), ["obs", "model_b"], "season"))


@plan("corr_by", with_views(f"""
    SELECT CAST(hour(dt) AS INTEGER) AS hour, {r(corr_sql('model_a', 'obs'))} AS corr
    FROM station_season GROUP BY 1""", "station_season"))
def corr_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.corr_by(V.station_season(spark, sf_dir), "model_a", "obs", "hour"))


@plan("corr_by_month", with_views(f"""
    SELECT {MONTH_SQL} AS month, {r(corr_sql('model_a', 'obs'))} AS corr FROM station_season GROUP BY 1
    """, "station_season"))
def corr_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.corr_by(V.station_season(spark, sf_dir), "model_a", "obs", "month"))


def _corr_rows(view: str, keys: str) -> str:
    parts = [f"SELECT {keys}, CAST(hour(dt) AS INTEGER) AS hour, '{c}' AS var, {corr_sql(c, 'obs')} AS corr "
             f"FROM {view} GROUP BY ALL" for c in ("model_a", "model_b")]
    names = keys.split(" AS ")[-1]
    return (f"SELECT {names}, hour, var, {r('corr')} AS corr FROM ({' UNION ALL '.join(parts)}) "
            "WHERE corr IS NOT NULL")


@plan("corr_by_slice_hour", with_views(_corr_rows("station_season", f"{MONTH_SQL} AS month"), "station_season"))
def corr_by_slice_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.corr_by_slice_hour(V.station_season(spark, sf_dir), ["model_a", "model_b"], "obs", "month"))


@plan("corr_by_season_hour", with_views(_corr_rows("station_season", f"{SEASON_SQL} AS season"), "station_season"))
def corr_by_season_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.corr_by_slice_hour(V.station_season(spark, sf_dir), ["model_a", "model_b"], "obs", "season"))


@plan("corr_by_regime_hour", with_views(f"""
    SELECT regime, hour, var, {r('corr')} AS corr FROM (
        SELECT regime, CAST(hour(dt) AS INTEGER) AS hour, 'model_a' AS var, {corr_sql('model_a', 'obs')} AS corr
        FROM regime_hour GROUP BY 1, 2) WHERE corr IS NOT NULL""", "regime_hour"))
def corr_by_regime_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.corr_by_regime_hour(V.regime_hour(spark, sf_dir), ["model_a"], "obs"))


def box_sql(source: str, keys: str, digits: int = 6) -> str:
    """Box statistics of ``v`` per key from a relation named ``source``."""
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    inside = f"v BETWEEN {low} AND {high}"
    on = " AND ".join(f"s.{k} = q.{k}" for k in keys.split(", "))
    group = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
        q AS (SELECT {keys}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
              FROM {source} GROUP BY {keys})
        SELECT {group}, count(*) AS n, {r('avg(v)', digits)} AS mean, {r('max(q1)', digits)} AS q1,
               {r('max(q2)', digits)} AS median, {r('max(q3)', digits)} AS q3,
               {r(f'min(CASE WHEN {inside} THEN v END)', digits)} AS whisker_low,
               {r(f'max(CASE WHEN {inside} THEN v END)', digits)} AS whisker_high,
               count(*) FILTER (NOT {inside}) AS outliers
        FROM {source} s JOIN q ON {on} GROUP BY {group}"""


def _long(view: str, key: str, *columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{c}' AS var, {c} AS v FROM {view}" for c in columns)


@plan("box_stats", with_views(f"""
    WITH rows_ AS ({_long('station_hour', 'CAST(hour(dt) AS INTEGER) AS hour', 'obs', 'model_b')}),
    {box_sql('rows_', 'hour, var')}""", "station_hour"))
def box_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.box_stats_by(V.station_hour(spark, sf_dir), ["obs", "model_b"]))


@plan("box_stats_by_season", with_views(f"""
    WITH tops AS (SELECT {SEASON_SQL} AS season, max(obs) AS top FROM station_season GROUP BY 1),
    rows_ AS (SELECT {SEASON_SQL} AS season, CAST(hour(dt) AS INTEGER) AS hour, 'obs' AS var, obs / top AS v
              FROM station_season JOIN tops ON tops.season = {SEASON_SQL}),
    {box_sql('rows_', 'season, hour, var')}""", "station_season"))
def box_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.box_stats_by(V.station_season(spark, sf_dir), ["obs"], "season", "slice_max"))


@plan("box_stats_by_month", with_views(f"""
    WITH rows_ AS (SELECT {MONTH_SQL} AS month, 'model_b' AS var,
                          model_b / (SELECT max(model_b) FROM station_season) AS v FROM station_season),
    {box_sql('rows_', 'month, var')}""", "station_season"))
def box_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir)
    return tidy(G.box_stats_by(rows, ["model_b"], normalise="global_max", axis="month"))


@plan("box_stats_by_month_hour", with_views(f"""
    WITH rows_ AS ({_long('station_season', f'{MONTH_SQL} AS month, CAST(hour(dt) AS INTEGER) AS hour', 'obs', 'model_b')}),
    {box_sql('rows_', 'month, hour, var')}""", "station_season"))
def box_by_month_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every hour within each month."""
    return tidy(G.box_stats_by(V.station_season(spark, sf_dir), ["obs", "model_b"], "month"))


@plan("box_stats_relative_error", with_views(f"""
    WITH means AS (SELECT hour(dt) AS h, avg(obs) AS m FROM station_hour GROUP BY 1),
    rows_ AS (SELECT CAST(hour(s.dt) AS INTEGER) AS hour, 'rel_error' AS var, (s.model_b - s.obs) / nullif(m, 0) AS v
              FROM station_hour s JOIN means ON hour(s.dt) = h WHERE m <> 0 AND s.model_b IS NOT NULL AND s.obs IS NOT NULL),
    {box_sql('rows_', 'hour, var')}""", "station_hour"))
def box_of_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per hour of the error over that hour's mean observation."""
    return tidy(G.box_stats_by(error_columns(V.station_hour(spark, sf_dir), "model_b", "obs"), ["rel_error"]))


@plan("box_stats_whole", f"""
    WITH rows_ AS (SELECT l_extendedprice AS v FROM lineitem),
    q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM rows_)
    SELECT count(*) AS n, {r('avg(v)', 3)} AS mean, {r('max(q1)', 3)} AS q1, {r('max(q2)', 3)} AS median, {r('max(q3)', 3)} AS q3,
           {r('min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END)', 3)} AS whisker_low,
           {r('max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END)', 3)} AS whisker_high,
           count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM rows_, q""")
def box_of_the_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box over all rows, ranked in strips side by side."""
    return tidy(box_stats(V.table(spark, sf_dir, "lineitem").select("l_extendedprice"), [], "l_extendedprice"), 3)


@plan("box_stats_narrowed", f"""
    WITH rows_ AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem),
    {box_sql('rows_', 'flag', 3)}""")
def box_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of a few heavy groups, whose ranks are bracketed by a sketch."""
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return tidy(box_stats(rows, ["flag"], "l_extendedprice"), 3)


def _hist_sql(c: str) -> str:
    return f"""
        SELECT '{c}' AS var, CAST(i AS INTEGER) AS bin, {r('lo + i * (hi - lo) / 10')} AS left_edge,
               {r('lo + (i + 1) * (hi - lo) / 10')} AS right_edge, coalesce(n, 0) AS n
        FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM training) b CROSS JOIN range(0, 10) AS t(i)
        LEFT JOIN (SELECT least(floor(({c} - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n
                   FROM training, (SELECT min({c}) AS lo, max({c}) AS hi FROM training) GROUP BY 1) h ON h.bin = i"""


@plan("histogram", with_views(" UNION ALL ".join(_hist_sql(c) for c in ("x1", "x2", "y")), "training"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.histogram(V.training(spark, sf_dir), ["x1", "x2", "y"]))


@plan("scatter_by", with_views(f"""
    SELECT CAST(hour(dt) AS INTEGER) AS "by", {r('model_b')} AS x, {r('obs')} AS y FROM station_hour""", "station_hour"))
def scatter_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.scatter_by(V.station_hour(spark, sf_dir), "model_b", "obs", "hour"))


@plan("scatter_by_month", with_views(f"""
    SELECT {MONTH_SQL} AS "by", {r('model_b')} AS x, {r('obs')} AS y FROM station_season""", "station_season"))
def scatter_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(G.scatter_by(V.station_season(spark, sf_dir), "model_b", "obs", "month"))


@plan("scatter_month", with_views(f"""
    SELECT strftime(dt, '%b') AS month, {r('model_b')} AS x, {r('obs')} AS y FROM station_season
    WHERE month(dt) IN (11, 12, 1, 2, 3, 4)""", "station_season"))
def scatter_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season's months; the one named twice counts once."""
    months = [*SEASON_MONTHS, SEASON_MONTHS[0]]
    return tidy(G.scatter_month(V.station_season(spark, sf_dir), "model_b", "obs", months))


@plan("zenith_ratio", with_views(f"""
    WITH days AS (
        SELECT dt, model_b / nullif(obs, 0) AS ratio,
               (epoch_us(dt - INTERVAL 4 HOUR) - 946728000000000) / CAST(86400000000.0 AS DOUBLE) AS n FROM station_hour),
    sun AS (
        SELECT *, ((n + 0.5) - floor(n + 0.5)) * 24.0 AS ut, radians(23.439 - 0.0000004 * n) AS tilt,
               radians(280.460 + 0.9856474 * n + 1.915 * sin(radians(357.528 + 0.9856003 * n))
                       + 0.020 * sin(2.0 * radians(357.528 + 0.9856003 * n))) AS ecl FROM days),
    sky AS (
        SELECT *, atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ra, asin(sin(tilt) * sin(ecl)) AS decl,
               radians(15.0 * (6.697375 + 0.0657098242 * n + ut + 55.0 / 15.0)) AS sidereal FROM sun),
    z AS (
        SELECT dt, ratio, degrees(acos(sin(radians(-22.0)) * sin(decl)
                                       + cos(radians(-22.0)) * cos(decl) * cos(sidereal - ra))) AS zenith FROM sky)
    SELECT strftime(dt, '%b') AS month, {r('CASE WHEN hour(dt) < 12 THEN -zenith ELSE zenith END', 5)} AS x,
           {r('ratio', 5)} AS y FROM z WHERE ratio IS NOT NULL""", "station_hour"))
def zenith_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    zenith = solar.signed_zenith(F.col("dt"), solar.solar_zenith_local(F.col("dt")))
    return tidy(G.zenith_ratio(rows, "model_b", "obs", zenith), 5)
