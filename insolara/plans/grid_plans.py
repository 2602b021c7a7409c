"""Grid reading, merging, station cells and gridded climatologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.timecol import whole_month
from insolara.operators import grid as R
from insolara.operators.reshape import with_position
from insolara.plans import views as V
from insolara.plans.registry import plan, r, tidy, with_views
from insolara.session import scratch_path
from insolara.sinks.grids import write_cells
from insolara.sources import grids as S

COARSE_LON = R.Axis(55.0, 0.1, 10)
COARSE_LAT = R.Axis(-21.6, 0.1, 10)
HOURLY_LON = R.Axis(55.0, 0.1, 10)
HOURLY_LAT = R.Axis(-21.6, 0.25, 4)


@plan("grid_long", with_views(f"""
    SELECT time, iy, ix, {r('lat')} AS lat, {r('lon')} AS lon, {r('u')} AS value FROM grid""", "grid"))
def grid_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly field packed into one array of rows per step, then unfolded."""
    rows = V.grid(spark, sf_dir).select("time", "iy", "ix", "u")
    packed = F.array(*[F.array(*[F.max(F.when((F.col("iy") == y) & (F.col("ix") == x), F.col("u"))) for x in range(10)])
                       for y in range(10)])
    arrays = rows.groupBy("time").agg(packed.alias("values"))
    lat = [-21.6 + 0.1 * i for i in range(10)]
    lon = [55.0 + 0.1 * i for i in range(10)]
    return tidy(S.grid_long(arrays, lat, lon).where(F.col("value").isNotNull()))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping files: every line number is a file with its own monthly fields."""
    line = V.table(spark, sf_dir, "lineitem")
    month = whole_month(F.col("l_shipdate"))
    return (line.groupBy(F.col("l_linenumber").alias("file_seq"), month.alias("time"),
                         F.floor(F.col("l_suppkey") % 100 / 10).cast("int").alias("iy"),
                         (F.col("l_suppkey") % 10).cast("int").alias("ix"))
            .agg(F.avg("l_quantity").alias("value")).withColumn("var", F.lit("u")))


FILES_SQL = """
    files AS (SELECT l_linenumber AS file_seq, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time,
                     CAST((l_suppkey % 100) // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix,
                     avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, iy, ix ORDER BY file_seq) AS rn FROM files)
               WHERE rn = 1)"""


@plan("merge_time", f"""
    WITH {FILES_SQL} SELECT time, iy, ix, 'u' AS var, file_seq, {r('value')} AS value FROM merged""")
def merge_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(S.merge_time(_files(spark, sf_dir)))


@plan("merge_time_steps", f"WITH {FILES_SQL} SELECT count(DISTINCT time) AS steps FROM merged")
def merge_time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.count_steps(S.merge_time(_files(spark, sf_dir)))


@plan("slice_steps", with_views(f"""
    SELECT time, step, iy, ix, {r('u')} AS u
    FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS step FROM grid) WHERE step BETWEEN 5 AND 20""", "grid"))
def slice_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.grid(spark, sf_dir).select("time", "iy", "ix", "u")
    return tidy(S.slice_steps(rows, 5, 20))


@plan("grid_times_from_start", with_views(f"""
    SELECT TIMESTAMP '2004-10-15 00:00:00' + to_hours(step) AS time, iy, ix, {r('u')} AS u
    FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS step FROM grid)""", "grid"))
def grid_times_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that only count, dated from a start."""
    rows = with_position(V.grid(spark, sf_dir).select("time", "iy", "ix", "u"), "time", name="step").drop("time")
    dated = S.grid_times_from_start(rows.withColumn("step", F.col("step").cast("int")), "2004-10-15 00:00:00")
    return tidy(dated.select("time", "iy", "ix", "u"))


def _first_sql(loc: str, axis: R.SpanAxis, half: float = 0.025) -> str:
    """The search as a list scan over the axis."""
    at = f"({axis.start}::DOUBLE + (j + 1) * ({axis.end}::DOUBLE - {axis.start}::DOUBLE) / {axis.n})"
    return (f"(SELECT CAST(min(j) AS INTEGER) FROM range(1, {axis.n}) AS t(j) "
            f"WHERE {at} BETWEEN {loc} - {half}::DOUBLE AND {loc} + {half}::DOUBLE)")


@plan("station_cell_first", with_views(f"""
    SELECT station_id, {r('lon')} AS lon, {r('lat')} AS lat, {_first_sql('lat', R.MODEL_LAT)} AS iy,
           {_first_sql('lon', R.MODEL_LON)} AS ix FROM station""", "station"))
def station_cell_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.station_cell_first(V.station(spark, sf_dir))
    return tidy(cells.select("station_id", "lon", "lat", "iy", "ix"))


def _nearest_sql(loc: str, axis: R.Axis) -> str:
    index = f"round_even(({loc} - ({axis.start}::DOUBLE)) / {axis.step}::DOUBLE, 0)"
    return f"CASE WHEN {index} BETWEEN 0 AND {axis.n - 1} THEN CAST({index} AS INTEGER) END"


@plan("station_cell_nearest", with_views(f"""
    SELECT station_id, {_nearest_sql('lat', COARSE_LAT)} AS iy, {_nearest_sql('lon', COARSE_LON)} AS ix
    FROM station""", "station"))
def station_cell_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.station_cell_nearest(V.station(spark, sf_dir), COARSE_LON, COARSE_LAT)
    return cells.select("station_id", "iy", "ix")


WHOLE_STEP = "1995-06-01"


@plan("nearest_on_axis", with_views(f"""
    WITH axis AS (SELECT DISTINCT ix AS i, lon AS c FROM grid WHERE time = TIMESTAMP '{WHOLE_STEP}'),
         pairs AS (SELECT s.station_id, a.i, row_number() OVER (
                       PARTITION BY s.station_id ORDER BY abs(a.c - s.lon), a.i) AS rn
                   FROM station s JOIN axis a ON abs(a.c - s.lon) <= 0.08::DOUBLE)
    SELECT s.station_id, p.i AS index FROM station s LEFT JOIN pairs p ON s.station_id = p.station_id AND p.rn = 1
    """, "station", "grid"))
def nearest_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis comes from one time step."""
    axis = R.axis_vector(V.grid(spark, sf_dir), "ix", "lon", WHOLE_STEP)
    held = V.station(spark, sf_dir).withColumn("axis", axis)
    return held.select("station_id", R.nearest_on_axis(F.col("lon"), F.col("axis"), 0.08).alias("index"))


def _box_sql(lat: str, lon: str, cells: str) -> str:
    return f"""
        cells AS ({cells}),
        found AS (SELECT s.station_id, c.iy, c.ix, row_number() OVER (PARTITION BY s.station_id ORDER BY c.iy, c.ix) AS rn
                  FROM station s JOIN cells c ON {lat} BETWEEN s.lat - 0.08::DOUBLE AND s.lat + 0.08::DOUBLE
                       AND {lon} BETWEEN s.lon - 0.08::DOUBLE AND s.lon + 0.08::DOUBLE),
        boxed AS (SELECT station_id, iy, ix FROM found WHERE rn = 1)"""


ALL_CELLS = "SELECT DISTINCT iy, ix, lat, lon FROM grid"


@plan("station_cell_box", with_views(f"""
    WITH {_box_sql('c.lat', 'c.lon', ALL_CELLS)} SELECT * FROM boxed""", "station", "grid"))
def station_cell_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_in_box(V.station(spark, sf_dir), R.grid_cells(V.grid(spark, sf_dir)), 0.16)


@plan("station_cell_curvilinear", with_views(f"""
    WITH {_box_sql('c.lat', 'c.lon', f"""
        SELECT DISTINCT iy, ix, lat + 0.011::DOUBLE * ix - 0.03::DOUBLE AS lat, lon + 0.007::DOUBLE * iy - 0.02::DOUBLE AS lon
        FROM grid WHERE time = TIMESTAMP '{WHOLE_STEP}'""")} SELECT * FROM boxed""", "station", "grid"))
def station_cell_curvilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheared grid, whose coordinates depend on both indices, from one time step."""
    cells = R.grid_cells(V.grid(spark, sf_dir), WHOLE_STEP)
    sheared = cells.withColumns({"lat": F.col("lat") + 0.011 * F.col("ix") - 0.03, "lon": F.col("lon") + 0.007 * F.col("iy") - 0.02})
    return R.cell_in_box(V.station(spark, sf_dir), sheared, 0.16)


NEAREST_CELLS = f"""
    cells AS (SELECT station_id, {_nearest_sql('lat', COARSE_LAT)} AS iy, {_nearest_sql('lon', COARSE_LON)} AS ix
              FROM station)"""


SHORT_LON = R.Axis(55.0, 0.1, 6)


@plan("unmatched_stations", with_views(f"""
    WITH cells AS (SELECT station_id, {_nearest_sql('lat', COARSE_LAT)} AS iy, {_nearest_sql('lon', SHORT_LON)} AS ix
                   FROM station)
    SELECT station_id FROM cells WHERE iy IS NULL OR ix IS NULL""", "station"))
def unmatched_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations east of a grid that ends too early."""
    cells = R.station_cell_nearest(V.station(spark, sf_dir), SHORT_LON, COARSE_LAT)
    return R.unmatched(cells).select("station_id")


@plan("extract_at_stations", with_views(f"""
    WITH {NEAREST_CELLS}
    SELECT c.station_id, g.time + INTERVAL 4 HOUR AS dt, {r('g.p', 3)} AS p
    FROM grid g JOIN cells c ON g.iy = c.iy AND g.ix = c.ix""", "station", "grid"))
def extract_at_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.station_cell_nearest(V.station(spark, sf_dir), COARSE_LON, COARSE_LAT)
    return tidy(R.extract_at_stations(V.grid(spark, sf_dir), cells, ["p"]), 3)


@plan("extract_in_box", with_views(f"""
    WITH {_box_sql('c.lat', 'c.lon', ALL_CELLS)}
    SELECT c.station_id, g.time + INTERVAL 4 HOUR AS dt, {r('g.p', 3)} AS p
    FROM grid g JOIN boxed c ON g.iy = c.iy AND g.ix = c.ix""", "station", "grid"))
def extract_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the first cell of each station's box."""
    cells = R.cell_in_box(V.station(spark, sf_dir), R.grid_cells(V.grid(spark, sf_dir)), 0.16)
    return tidy(R.extract_at_stations(V.grid(spark, sf_dir), cells, ["p"]), 3)


SPAN_LON, SPAN_LAT = R.SpanAxis(54.9, 55.9, 10), R.SpanAxis(-21.7, -20.7, 10)
FIRST_CELLS = f"""
    cells AS (SELECT station_id, {_first_sql('lat', SPAN_LAT, 0.08)} AS iy, {_first_sql('lon', SPAN_LON, 0.08)} AS ix FROM station)"""


def _first_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.station_cell_first(V.station(spark, sf_dir), SPAN_LON, SPAN_LAT, 0.16)


@plan("extract_first_match", with_views(f"""
    WITH {FIRST_CELLS}
    SELECT c.station_id, g.time + INTERVAL 4 HOUR AS dt, {r('g.p', 3)} AS p
    FROM grid g JOIN cells c ON g.iy = c.iy AND g.ix = c.ix""", "station", "grid"))
def extract_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the cell at which a search along each axis stops."""
    return tidy(R.extract_at_stations(V.grid(spark, sf_dir), _first_cells(spark, sf_dir), ["p"]), 3)


@plan("extract_stored", with_views(f"""
    WITH {FIRST_CELLS}
    SELECT c.station_id, g.time + INTERVAL 4 HOUR AS dt, {r('g.p', 3)} AS p
    FROM grid g JOIN cells c ON g.iy = c.iy AND g.ix = c.ix""", "station", "grid"))
def extract_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a grid stored by tiles, of which only the stations' tiles are read."""
    path = scratch_path(spark, "cells")
    write_cells(V.grid(spark, sf_dir), path)
    return tidy(R.extract_stored(spark.read.parquet(path), _first_cells(spark, sf_dir), ["p"]), 3)


@plan("cell_hour_mean", with_views(f"""
    SELECT iy, ix, CAST(hour(time) AS INTEGER) AS hour, {r('avg(value)')} AS value FROM hourly_grid
    WHERE hour(time) BETWEEN 8 AND 17 GROUP BY 1, 2, 3""", "hourly_grid"))
def cell_hour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.cell_hour_mean(V.hourly_grid(spark, sf_dir), hours=range(8, 18)))


@plan("cell_mean", with_views(f"""
    SELECT iy, ix, {r('avg(value)')} AS value FROM hourly_grid GROUP BY 1, 2""", "hourly_grid"))
def cell_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.cell_mean(V.hourly_grid(spark, sf_dir)))


MONTHS = ["1994-11-01", "1994-12-01", "1995-01-01", "1995-02-01", "1995-03-01", "1995-04-01"]


@plan("monthly_field", with_views(f"""
    SELECT time, iy, ix, {r('lat')} AS lat, {r('lon')} AS lon, {r('u')} AS u, {r('v')} AS v, {r('p', 3)} AS p,
           CASE WHEN u BETWEEN -10 AND 10 THEN CAST(least(floor((u + 10) / 2), 9) AS INTEGER) END AS u_band,
           CASE WHEN p BETWEEN 98947 AND 102247 THEN CAST(least(floor((p - 98947) / 300), 10) AS INTEGER) END AS p_band
    FROM grid WHERE time IN ({', '.join(f"TIMESTAMP '{m}'" for m in MONTHS)})
          AND lon BETWEEN 52 AND 60 AND lat BETWEEN -23 AND -17.9 AND iy % 2 = 0 AND ix % 2 = 0""", "grid"))
def monthly_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.monthly_field(V.grid(spark, sf_dir), MONTHS, "reu_mau", 2), p=3)


@plan("widen_grid", with_views(f"""
    SELECT time, iy, ix, {r('u')} AS u, {r('v')} AS v FROM grid""", "grid"))
def widen_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field as one row per variable and back to one column each."""
    rows = V.grid(spark, sf_dir).select("time", "iy", "ix", "u", "v", "p")
    long = rows.unpivot(["time", "iy", "ix"], ["u", "v", "p"], "var", "value")
    return tidy(R.widen(long, ["u", "v"], ["time", "iy", "ix"]))


@plan("station_hour_cloud_bias", with_views(f"""
    WITH c AS (SELECT station_id, {_nearest_sql('lat', HOURLY_LAT)} AS iy, {_nearest_sql('lon', HOURLY_LON)} AS ix
               FROM station),
         b AS (SELECT station_id, CAST(hour(dt) AS INTEGER) AS hour, avg(model_b - obs) AS bias FROM station_season
               WHERE hour(dt) BETWEEN 8 AND 17 AND month(dt) IN (12, 1, 2) GROUP BY 1, 2),
         g AS (SELECT iy, ix, CAST(hour(time) AS INTEGER) AS hour, avg(value) AS cloud FROM hourly_grid
               WHERE hour(time) BETWEEN 8 AND 17 AND month(time) IN (12, 1, 2) GROUP BY 1, 2, 3)
    SELECT b.station_id, b.hour, {r('bias')} AS bias, {r('cloud')} AS cloud,
           CASE WHEN cloud BETWEEN 60 AND 100 THEN CAST(least(floor((cloud - 60) / 2), 19) AS INTEGER) END AS cloud_band,
           CAST(least(greatest(floor((bias + 240) / 480 * 20) + 1, 1), 20) AS INTEGER) AS bias_class
    FROM b LEFT JOIN c ON b.station_id = c.station_id
         LEFT JOIN g ON c.iy = g.iy AND c.ix = g.ix AND b.hour = g.hour""", "station", "station_season", "hourly_grid"))
def station_hour_cloud_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    winter = F.month("time").isin(12, 1, 2)
    rows = V.station_season(spark, sf_dir).where(F.month("dt").isin(12, 1, 2))
    cells = R.station_cell_nearest(V.station(spark, sf_dir), HOURLY_LON, HOURLY_LAT)
    grid = V.hourly_grid(spark, sf_dir).where(winter)
    return tidy(R.station_hour_cloud_bias(grid, rows, cells, "model_b", "obs"))
