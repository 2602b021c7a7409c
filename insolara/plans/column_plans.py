"""Calendar, zone, solar and value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions import solar, timecol
from insolara.operators.diurnal import normalise_by_max
from insolara.operators.stations import attach_location, station_mean
from insolara.operators.verify import error_columns
from insolara.plans import views as V
from insolara.plans.registry import plan, r, tidy, with_views

SEASON_SQL = "CAST((month(dt) % 12 + 3) // 3 AS INTEGER)"


@plan("calendar_features", with_views(f"""
    SELECT station_id, dt, CAST(hour(dt) AS INTEGER) AS hour, CAST(isodow(dt) - 1 AS INTEGER) AS weekday,
           CAST(month(dt) AS INTEGER) AS month, {SEASON_SQL} AS season, dayname(dt) AS day_name
    FROM station_season""", "station_season"))
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir)
    return rows.select("station_id", "dt", *[c.alias(n) for n, c in timecol.calendar_columns(F.col("dt")).items()])


@plan("season", with_views(f"""
    SELECT {SEASON_SQL} AS season, count(*) AS n FROM station_season GROUP BY 1""", "station_season"))
def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir)
    return rows.groupBy(timecol.season(F.col("dt")).alias("season")).agg(F.count("*").alias("n"))


BLOCK_SQL = """CASE WHEN month(dt) IN (2, 3, 4) THEN '020304' WHEN month(dt) IN (5, 6, 7) THEN '050607'
               WHEN month(dt) IN (8, 9, 10) THEN '080910' ELSE '111201' END"""


@plan("training_block", with_views(f"""
    SELECT {BLOCK_SQL} AS training_block, count(*) AS n, {r('avg(x1)')} AS x1 FROM training GROUP BY 1""", "training"))
def training_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.training(spark, sf_dir)
    return tidy(rows.groupBy(timecol.training_block(F.col("dt")).alias("training_block"))
                .agg(F.count("*").alias("n"), F.avg("x1").alias("x1")))


@plan("utc_to_local", with_views("""
    SELECT station_id, dt, dt + INTERVAL 4 HOUR AS local_time FROM station_hour""", "station_hour"))
def utc_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return rows.select("station_id", "dt", timecol.utc_to_local(F.col("dt")).alias("local_time"))


@plan("local_to_utc", with_views("""
    SELECT station_id, dt, dt - INTERVAL 4 HOUR AS utc_time FROM station_hour""", "station_hour"))
def local_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return rows.select("station_id", "dt", timecol.local_to_utc(F.col("dt")).alias("utc_time"))


@plan("epoch_ns", """
    SELECT event_id, CAST(epoch_us(ts - INTERVAL 4 HOUR) * 1000 AS BIGINT) AS epoch_ns FROM events""")
def epoch_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", timecol.epoch_ns(F.col("ts")).alias("epoch_ns"))


ZENITH_SQL = f"""
    days AS (
        SELECT s.station_id, s.dt, t.lat, t.lon,
               (epoch_us(s.dt) - 946728000000000) / CAST(86400000000.0 AS DOUBLE) AS n
        FROM station_hour s JOIN station t ON s.station_id = t.station_id),
    sun AS (
        SELECT *, ((n + 0.5) - floor(n + 0.5)) * 24.0 AS ut,
               radians(280.460 + 0.9856474 * n + 1.915 * sin(radians(357.528 + 0.9856003 * n))
                       + 0.020 * sin(2.0 * radians(357.528 + 0.9856003 * n))) AS ecl,
               radians(23.439 - 0.0000004 * n) AS tilt
        FROM days),
    sky AS (
        SELECT *, atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ra, asin(sin(tilt) * sin(ecl)) AS decl,
               radians(15.0 * (6.697375 + 0.0657098242 * n + ut + lon / 15.0)) AS sidereal
        FROM sun),
    zenith AS (
        SELECT station_id, dt, degrees(acos(greatest(-1.0, least(1.0,
               sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(sidereal - ra))))) AS zenith
        FROM sky)"""


@plan("solar_zenith", with_views(f"""
    WITH {ZENITH_SQL} SELECT station_id, dt, {r('zenith', 5)} AS zenith FROM zenith""", "station_hour", "station"))
def solar_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attach_location(V.station_hour(spark, sf_dir).select("station_id", "dt"), V.station(spark, sf_dir),
                           how="inner")
    zenith = solar.solar_zenith(F.col("dt"), F.col("lat"), F.col("lon"))
    return tidy(rows.select("station_id", "dt", zenith.alias("zenith")), 5)


@plan("signed_zenith", with_views(f"""
    WITH {ZENITH_SQL}
    SELECT station_id, dt, {r('CASE WHEN hour(dt) < 12 THEN -zenith ELSE zenith END', 5)} AS zenith FROM zenith
    """, "station_hour", "station"))
def signed_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attach_location(V.station_hour(spark, sf_dir).select("station_id", "dt"), V.station(spark, sf_dir),
                           how="inner")
    zenith = solar.solar_zenith(F.col("dt"), F.col("lat"), F.col("lon"))
    return tidy(rows.select("station_id", "dt", solar.signed_zenith(F.col("dt"), zenith).alias("zenith")), 5)


@plan("bias", with_views(f"SELECT station_id, dt, {r('model_b - obs')} AS bias FROM station_hour", "station_hour"))
def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return tidy(rows.select("station_id", "dt", C.bias(F.col("model_b"), F.col("obs")).alias("bias")))


@plan("abs_diff", with_views(f"""
    SELECT station_id, dt, {r('abs(model_a - model_b)')} AS abs_diff FROM station_hour""", "station_hour"))
def abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return tidy(rows.select("station_id", "dt", C.abs_diff(F.col("model_a"), F.col("model_b")).alias("abs_diff")))


@plan("ratio", with_views(f"""
    SELECT event_id, {r('k / nullif(floor(value), 0)')} AS ratio FROM event_rows""", "event_rows"))
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.event_rows(spark, sf_dir)
    whole = F.floor("value").cast("double")
    return tidy(rows.select("event_id", C.ratio(F.col("k"), whole).alias("ratio")))


@plan("convert_units", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_extendedprice / 86400')} AS flux,
           {r('round_even(l_quantity + 250 - 273.15, 3)')} AS celsius FROM lineitem""")
def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem")
    flux = C.flux_from_accumulated(F.col("l_extendedprice")).alias("flux")
    celsius = C.kelvin_to_celsius(F.col("l_quantity") + 250.0).alias("celsius")
    return tidy(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flux, celsius))


@plan("normalise_by_max", with_views(f"""
    SELECT s.station_id, s.dt, {r('s.obs / t.top')} AS obs, {r('s.model_b / g.top')} AS model_b
    FROM station_season s JOIN (SELECT month(dt) AS month, max(obs) AS top FROM station_season GROUP BY 1) t
      ON month(s.dt) = t.month, (SELECT max(model_b) AS top FROM station_season) g""", "station_season"))
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir).withColumn("month", F.month("dt"))
    by_month = normalise_by_max(rows, ["obs"], ["month"])
    return tidy(normalise_by_max(by_month, ["model_b"]).select("station_id", "dt", "obs", "model_b"))


@plan("month_name", with_views("""
    SELECT monthname(dt) AS month, strftime(dt, '%b') AS short, count(*) AS n
    FROM station_season GROUP BY 1, 2""", "station_season"))
def month_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_season(spark, sf_dir)
    return rows.groupBy(timecol.month_name(F.col("dt")).alias("month"),
                        timecol.month_name(F.col("dt"), True).alias("short")).agg(F.count("*").alias("n"))


def bounds_sql(value: str, n: int = 10) -> str:
    """Readable bounds of a column as two SQL expressions over an aggregate."""
    digits = f"(CASE WHEN max({value}) - min({value}) < 10 THEN {{}} ELSE {{}} END)"

    def settle(edge: str) -> str:
        part = f"{edge}({value}) / {float(n)}"
        return digits.format(f"round_even({part}, 2)", f"round_even({part}, 0)") + f" * {float(n)}"

    return f"{settle('min')} AS lo, {settle('max')} AS hi"


@plan("nice_bounds", with_views(f"""
    WITH m AS (SELECT station_id, avg(obs) AS obs, avg(model_b - obs) AS bias FROM station_hour GROUP BY 1),
         a AS (SELECT {bounds_sql('obs')} FROM m), b AS (SELECT {bounds_sql('bias')} FROM m)
    SELECT {r('a.lo', 3)} AS lo, {r('a.hi', 3)} AS hi, {r('-greatest(abs(b.lo), abs(b.hi))', 3)} AS bias_lo,
           {r('greatest(abs(b.lo), abs(b.hi))', 3)} AS bias_hi FROM a, b""", "station_hour"))
def nice_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir).withColumn("bias", F.col("model_b") - F.col("obs"))
    means = station_mean(rows, ["obs", "bias"])
    lo, hi = C.nice_bounds(F.min("obs"), F.max("obs"))
    bias_lo, bias_hi = C.nice_bounds(F.min("bias"), F.max("bias"), symmetric=True)
    return tidy(means.agg(lo.alias("lo"), hi.alias("hi"), bias_lo.alias("bias_lo"), bias_hi.alias("bias_hi")), 3)


def class_sql(value: str, lo: float, hi: float, n: int) -> str:
    return (f"CAST(least(greatest(floor(({value} - ({lo})) / ({hi} - ({lo})) * {float(n)}) + 1, 1), {n}) AS INTEGER)")


@plan("value_class", with_views(f"""
    SELECT {class_sql('model_a - obs', -340.0, 340.0, 10)} AS class10,
           {class_sql('model_a - obs', -240.0, 240.0, 20)} AS class20, count(*) AS n
    FROM station_hour GROUP BY 1, 2""", "station_hour"))
def value_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = C.bias(F.col("model_a"), F.col("obs"))
    return (V.station_hour(spark, sf_dir)
            .groupBy(C.value_class(value, -340.0, 340.0, 10).alias("class10"),
                     C.value_class(value, -240.0, 240.0, 20).alias("class20")).agg(F.count("*").alias("n")))


@plan("contour_class", with_views("""
    SELECT CASE WHEN u BETWEEN -10 AND 10 THEN CAST(least(floor((u + 10) / 2), 9) AS INTEGER) END AS band,
           count(*) AS n FROM grid GROUP BY 1""", "grid"))
def contour_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = C.contour_class(F.col("u"), *C.CONTOURS["zonal_wind"]).alias("band")
    return V.grid(spark, sf_dir).groupBy(band).agg(F.count("*").alias("n"))


@plan("format_value", with_views("""
    SELECT station_id, dt, printf('%.4f', model_a) AS four, printf('%.3f', model_a) AS three,
           printf('%02d', hour(dt)) AS hour FROM station_hour""", "station_hour"))
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.station_hour(spark, sf_dir)
    return rows.select("station_id", "dt", C.fixed_text(F.col("model_a"), 4).alias("four"),
                       C.fixed_text(F.col("model_a"), 3).alias("three"), C.two_digit(F.hour("dt")).alias("hour"))


@plan("error_columns", with_views(f"""
    SELECT s.station_id, s.dt, {r('model_b - obs')} AS error, {r('abs(model_b - obs)')} AS abs_error,
           {r('(model_b - obs) / nullif(h.m, 0)')} AS rel_error, abs(obs - model_b) <= obs * 0.05 AS hit5,
           abs(obs - model_b) <= obs * 0.08 AS hit8
    FROM station_hour s JOIN (SELECT hour(dt) AS hour, avg(obs) AS m FROM station_hour GROUP BY 1) h
      ON hour(s.dt) = h.hour""", "station_hour"))
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = error_columns(V.station_hour(spark, sf_dir), "model_b", "obs")
    return tidy(rows.select("station_id", "dt", "error", "abs_error", "rel_error", "hit5", "hit8"))
