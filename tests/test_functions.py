"""Column functions on hand-made values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions import scores, solar, timecol
from insolara.functions.nulls import clean_frame, drop_incomplete, inf_to_null
from insolara.operators.verify import forecast_scores, verify_by_station
from tests.conftest import at, rows


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, -99999.0), (5, float("inf"))],
                               "id int, v double")
    assert [r[1] for r in rows(clean_frame(df, [-99999.0]), "id")] == [1.0, None, None, None, None]
    assert [r[0] for r in rows(drop_incomplete(df), "id")] == [1, 4]
    kept = [r[0] for r in rows(df.select(inf_to_null(F.col("v")).alias("v"), "id"), "id")]
    assert kept[4] is None and kept[3] == -99999.0


def test_calendar_numbers(spark):
    df = spark.createDataFrame([(at("2004-12-06 13:00:00"),), (at("2005-04-10 00:00:00"),)], "dt timestamp_ntz")
    got = rows(df.select(*[c.alias(n) for n, c in timecol.calendar_columns(F.col("dt")).items()]), F.col("month").desc())
    assert got[0] == (13, 0, 12, 1, "Monday")
    assert got[1] == (0, 6, 4, 2, "Sunday")


@pytest.mark.parametrize("month,block", [(2, "020304"), (7, "050607"), (10, "080910"), (11, "111201"), (1, "111201")])
def test_training_blocks(spark, month, block):
    moment = F.lit(f"2005-{month:02d}-15 00:00:00").cast("timestamp_ntz")
    assert one(spark, timecol.training_block(moment)) == block


def test_unknown_grouping_raises():
    with pytest.raises(ValueError):
        timecol.by_column(None, "year")


def test_zone_shift_and_epoch(spark):
    utc = F.lit("2004-11-01 00:00:00").cast("timestamp_ntz")
    assert one(spark, timecol.utc_to_local(utc)) == at("2004-11-01 04:00:00")
    assert one(spark, timecol.local_to_utc(timecol.utc_to_local(utc))) == at("2004-11-01 00:00:00")
    local = F.lit("2004-11-01 04:00:00").cast("timestamp_ntz")
    assert one(spark, timecol.epoch_ns(local)) == 1099267200000000000
    assert one(spark, timecol.epoch_ns(utc)) == 1099252800000000000


def test_epoch_ignores_session_zone(spark):
    moment = F.lit("2004-07-01 12:34:56.789012").cast("timestamp_ntz")
    before = one(spark, timecol.epoch_micros_utc(moment))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert one(spark, timecol.epoch_micros_utc(moment)) == before == 1088685296789012
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zenith_geometry(spark):
    def zenith(text, lat, lon):
        return one(spark, solar.solar_zenith(F.lit(text).cast("timestamp_ntz"), lat, lon))

    assert zenith("2005-06-21 12:02:00", 23.44, 0.0) < 0.5
    assert zenith("2005-12-21 11:58:00", -23.44, 0.0) < 0.5
    assert abs(zenith("2005-06-21 00:02:00", 66.56, 0.0) - 90.0) < 0.3
    noon = zenith("2004-12-15 08:20:00", -21.1, 55.5)
    assert 1.5 < noon < 4.0
    early, late = zenith("2005-03-20 06:07:30", 0.0, 0.0), zenith("2005-03-20 18:07:30", 0.0, 0.0)
    assert abs(early - late) < 0.5 and abs(early - 90) < 0.5


def test_signed_zenith(spark):
    dt = F.lit("2005-01-01 08:00:00").cast("timestamp_ntz")
    assert one(spark, solar.signed_zenith(dt, F.lit(30.0))) == -30.0


def test_rounding_to_even(spark):
    df = spark.createDataFrame([(1, 2.5), (2, -2.5), (3, 3.5)], "id int, v double")
    assert [r[0] for r in rows(df.orderBy("id").select(C.half_even(F.col("v"), 0)))] == [2.0, -2.0, 4.0]
    assert one(spark, C.half_even(F.lit(0.125), 2)) == 0.12


def test_units(spark):
    assert one(spark, C.kelvin_to_celsius(F.lit(300.0))) == 26.85
    assert one(spark, C.kelvin_to_celsius(F.lit(300.0), C.PARITY_KELVIN_OFFSET)) == 26.5
    assert one(spark, C.flux_from_accumulated(F.lit(85400.0), C.PARITY_DAY_SECONDS)) == 1.0


def test_ratio_of_zero_is_null(spark):
    assert one(spark, C.ratio(F.lit(3.0), F.lit(0.0))) is None


def test_classes(spark):
    for value, want in ((-1000.0, 1), (-340.0, 1), (-339.9, 1), (0.0, 6), (339.0, 10), (340.0, 10), (999.0, 10)):
        assert one(spark, C.value_class(F.lit(value), -340.0, 340.0, 10)) == want
    assert one(spark, C.value_class(F.lit(2.0), 2.0, 2.0)) == 1
    for value, want in ((-10.1, None), (-10.0, 0), (9.9, 9), (10.0, 9), (10.1, None)):
        assert one(spark, C.contour_class(F.lit(value), -10.0, 10.0, 2.0)) == want


def test_nice_bounds(spark):
    lo, hi = C.nice_bounds(F.lit(1.0), F.lit(8.0))
    assert (one(spark, lo), one(spark, hi)) == (1.0, 8.0)
    lo, hi = C.nice_bounds(F.lit(112.0), F.lit(348.0))
    assert (one(spark, lo), one(spark, hi)) == (110.0, 350.0)
    lo, hi = C.nice_bounds(F.lit(-112.0), F.lit(248.0), symmetric=True)
    assert (one(spark, lo), one(spark, hi)) == (-250.0, 250.0)


def test_hit_needs_a_positive_observation(spark):
    assert one(spark, C.hit(F.lit(100.0), F.lit(104.0), 0.05)) is True
    assert one(spark, C.hit(F.lit(-100.0), F.lit(-100.0), 0.05)) is False


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 4.0, 5.0)], "station_id int, m double, o double")
    got = verify_by_station(df, "m", "o").first()
    assert got["corr"] is None and got["mean_bias"] == pytest.approx(7 / 3 - 5)


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 5.0), (1, None, 9.0)],
                               "station_id int, m double, o double")
    got = verify_by_station(df, "m", "o").first()
    assert got["mean_bias"] == pytest.approx(-1.0)
    assert got["mae"] == pytest.approx(1.0)
    assert got["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert got["r2"] == pytest.approx(1 - 5 / 2)
    obs = verify_by_station(df, "m", "o", truth="obs").first()
    assert obs["r2"] == pytest.approx(1 - 5 / 6)
    with pytest.raises(ValueError):
        scores.r2(F.col("m"), F.col("o"), truth="both")


def test_forecast_scores_skip_zero_observations(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 10.4), (20.0, 21.4)], "o double, p double")
    got = forecast_scores(df, "p", "o").first()
    assert got["n"] == 3
    assert got["mape"] == pytest.approx((0.04 + 0.07) / 2 * 100)
    assert got["hit5"] == pytest.approx(1 / 3)
    assert got["hit8"] == pytest.approx(2 / 3)
    assert got["nmae"] == pytest.approx((1 + 0.4 + 1.4) / 3 / 20 * 100)


def test_bic_of_known_numbers(spark):
    df = spark.createDataFrame([(float(i), float(i + 4)) for i in range(1, 5)], "o double, p double")
    got = df.agg(scores.regression_bic(F.col("o"), F.col("p"), 3).alias("b")).first()["b"]
    assert round(got, 3) == 15.249


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.datetimes(min_value=at("1970-01-02"), max_value=at("2090-01-01")))
def test_zone_round_trip(spark, moment):
    df = spark.createDataFrame([(moment,)], "dt timestamp_ntz")
    back = df.select(timecol.local_to_utc(timecol.utc_to_local(F.col("dt"))).alias("v")).first()["v"]
    assert back == moment
