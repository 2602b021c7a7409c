"""Operators against brute force and hand-made frames."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insolara.operators import align as A
from insolara.operators import calendar as K
from insolara.operators import diurnal as G
from insolara.operators import filters as D
from insolara.operators import grid as R
from insolara.operators import quantiles as Q
from insolara.operators import reshape as H
from insolara.operators import stations as S
from insolara.operators import stats as L
from insolara.operators.verify import error_columns, error_series, hourly_uncertainty
from insolara.sinks.grids import write_cells
from insolara.sources.grids import slice_steps
from tests.conftest import at, rows

STATION = "station_id int, dt timestamp_ntz, v double"


def hours(start, count, station=1, skip=()):
    begin = at(start)
    return [(station, begin + dt.timedelta(hours=i), float(i)) for i in range(count) if i not in skip]


# --- filters and calendars ------------------------------------------------------------------


def test_bounds_are_inclusive_and_months_distinct(spark):
    df = spark.createDataFrame(hours("2005-04-30 22:00:00", 4), STATION)
    assert D.time_range(df, D.SEASON_START, "2005-04-30 23:00:00").count() == 2
    assert D.month_slice(df, [4, 2, 4, 11]).count() == 2
    assert D.hour_range(df, 0, 1).count() == 2


def test_areas():
    assert D.area_box("reu_mau") == (52.0, 60.0, -23.0, -17.9)
    with pytest.raises(ValueError):
        D.area_box("nowhere")


def test_box_around_a_point(spark):
    df = spark.createDataFrame([(55.0, -21.0), (55.02, -21.02), (55.03, -21.0)], "lon double, lat double")
    assert D.around(df, 55.0, -21.0, 0.05).count() == 2


def test_expand_days_removes_duplicates(spark):
    days = spark.createDataFrame([(at("2021-02-27"),), (at("2021-02-27"),), (at("2021-02-28"),)], "day timestamp_ntz")
    assert K.expand_days(days, "day", "H", 30).count() == 54
    assert K.expand_days(days, "day", "60min", 20).count() == 40
    assert K.expand_days(days, "day", "D", 2).count() == 3
    assert K.expand_days(days, "day", "m", 2).agg(F.max("dt")).first()[0] == at("2021-03-28")


def test_step_times_of_the_whole_run(spark):
    df = spark.createDataFrame([(at("2004-10-15 00:00:00"), 4747)], "s timestamp_ntz, n int")
    got = K.step_times(df, "s", "n").agg(F.count("*"), F.max("dt")).first()
    assert tuple(got) == (4747, at("2005-04-30 18:00:00"))


# --- completeness ---------------------------------------------------------------------------


def brute_completeness(data, first=8, last=17):
    stations = {s for s, *_ in data}
    months = {}
    for _, t, *_ in data:
        months.setdefault((t.year, t.month), []).append(t)
    out = {}
    for key, times in months.items():
        step, expected = min(times), []
        while step <= max(times):
            if first <= step.hour <= last:
                expected.append(step)
            step += dt.timedelta(hours=1)
        for s in stations:
            own = {t for station, t, *_ in data if station == s and (t.year, t.month) == key}
            missing = [e for e in expected if e not in own]
            out[(*key, s)] = (len(expected), len(missing), {t.day for t in own}, missing)
    return out


@pytest.mark.parametrize("minute", [0, 30])
def test_completeness_equals_enumeration(spark, minute):
    rng = random.Random(3)
    data = []
    for station in (1, 2, 3):
        for i in range(24 * 45):
            moment = at("2005-01-10 03:00:00") + dt.timedelta(hours=i, minutes=minute)
            if rng.random() < 0.8 and not (station == 3 and moment.month == 2):
                data.append((station, moment, 1.0))
                if rng.random() < 0.05:
                    data.append((station, moment + dt.timedelta(minutes=7), 1.0))
    df = spark.createDataFrame(data, STATION)
    want = brute_completeness(data)
    got = {(r["year"], r["month"], r["station_id"]): r for r in S.completeness(df).collect()}
    assert set(got) == set(want)
    for key, (expected, missing, days, _) in want.items():
        r = got[key]
        assert (r["expected"], r["missing"], r["days"], r["complete"]) == (expected, missing, len(days), missing == 0)
        assert r["expected"] == r["present"] + r["missing"]
    lacking = sorted((s, t) for (_, _, s), (*_, gaps) in want.items() for t in gaps)
    assert [(r["station_id"], r["dt"]) for r in S.missing_steps(df).orderBy("station_id", "dt").collect()] == lacking
    assert S.missing_map(df).count() == len(lacking)


def test_one_missing_hour(spark):
    df = spark.createDataFrame(hours("2005-01-01 00:00:00", 24, 1, {13}) + hours("2005-01-01 00:00:00", 24, 2), STATION)
    assert [r["dt"] for r in S.missing_steps(df).collect()] == [at("2005-01-01 13:00:00")]
    prefix = H.contiguous_prefix(df, by=["station_id"])
    assert rows(prefix.groupBy("station_id").agg(F.count("*"), F.max("v")), "station_id") == [(1, 13, 12.0), (2, 24, 23.0)]
    assert H.contiguous_prefix(df.where("station_id = 1")).count() == 13


# --- windows and reshaping ------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_positions_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(1)
    moments = [at("2005-01-01") + dt.timedelta(minutes=rng.randrange(60 * 24 * 90)) for _ in range(400)]
    df = spark.createDataFrame([(i % 3, m, 0.0) for i, m in enumerate(moments)], STATION).repartition(parts)
    got = {(s, t): p for s, t, p in rows(H.step_position(df, "dt", ["station_id"]))}
    for s in range(3):
        own = sorted({m for i, m in enumerate(moments) if i % 3 == s})
        assert [got[(s, m)] for m in own] == list(range(len(own)))
    overall = {t: p for t, p in rows(H.step_position(df))}
    assert [overall[m] for m in sorted(set(moments))] == list(range(len(set(moments))))


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, at("2005-01-01"), 1.0), (None, at("2005-01-02"), 2.0), (1, at("2005-01-01"), 3.0)],
                               STATION)
    got = H.with_position(df, "dt", ["station_id"])
    assert rows(got.select("station_id", "v", "position"), "v") == [(None, 1.0, 0), (None, 2.0, 1), (1, 3.0, 0)]
    normal = G.normalise_by_max(df, ["v"], ["station_id"])
    assert sorted(r["v"] for r in normal.collect()) == [0.5, 1.0, 1.0]


def test_slice_steps(spark):
    df = spark.createDataFrame([(at(f"2005-01-0{d}"), i) for d in (1, 2, 3, 4) for i in range(5)],
                               "time timestamp_ntz, ix int")
    got = slice_steps(df, 1, 2)
    assert got.count() == 10 and {r["time"].day for r in got.collect()} == {2, 3}


def test_keep_first_and_best(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 7.0), ("b", 1, 1.0)], "k string, o int, v double")
    assert rows(H.keep_first(df, ["k"], ["o"]), "k") == [("a", 1, 7.0), ("b", 1, 1.0)]
    assert rows(H.arg_best(df, "v", ["o"], ["k"]), "k") == [("a", 2, 5.0), ("b", 1, 1.0)]
    assert H.arg_best(df, "v", ["k"]).first()["k"] == "b"
    assert sorted(r["delta"] for r in H.above_best(df, "v").collect()) == [0.0, 4.0, 6.0]


def test_profile_with_a_missing_hour_is_flagged(spark):
    data = hours("2005-01-01 08:00:00", 10, 1) + hours("2005-01-01 08:00:00", 10, 2, {4})
    got = rows(H.profile_vector(spark.createDataFrame(data, STATION), "station_id", "v"), "station_id")
    assert got[0] == (1, [float(i) for i in range(10)], True)
    assert got[1][2] is False and got[1][1][4] is None


# --- joins ----------------------------------------------------------------------------------


def test_align_sources_keeps_every_key(spark):
    a = spark.createDataFrame([(1, at("2005-01-01"), 1.0), (1, at("2005-01-02"), 2.0)], "station_id int, dt timestamp_ntz, value double")
    b = spark.createDataFrame([(1, at("2005-01-02"), 5.0), (2, at("2005-01-02"), 6.0)], "station_id int, dt timestamp_ntz, value double")
    got = rows(A.align_sources({"a": a, "b": b}), "station_id", "dt")
    assert got == [(1, at("2005-01-01"), 1.0, None), (1, at("2005-01-02"), 2.0, 5.0), (2, at("2005-01-02"), None, 6.0)]
    assert A.align_subtract(a, b.where("station_id = 1"), keys=["station_id", "dt"]).first()["error"] == -3.0


def test_relative_error_uses_the_hour(spark):
    data = [(at("2005-01-01 10:00:00"), 10.0, 12.0), (at("2005-01-02 10:00:00"), 30.0, 30.0), (at("2005-01-01 23:00:00"), 0.0, 1.0)]
    df = spark.createDataFrame(data, "dt timestamp_ntz, obs double, pred double")
    got = rows(error_columns(df, "pred", "obs").select("rel_error", "hit5"), "obs", "dt")
    assert got == [(None, False), (0.1, False), (0.0, True)]
    made = {r["hour"]: r for r in hourly_uncertainty(df, "pred", "obs").collect()}
    assert made[10]["mean_error"] == 1.0 and made[23]["overall_error"] == 1.0 and made[10]["days"] == 2
    assert error_series(df, "pred", "obs", first_day=True).count() == 3


# --- grid -----------------------------------------------------------------------------------


def searched(axis, location, reso):
    """First cell from the second on whose coordinate is within half a resolution."""
    coordinates = axis.start + np.arange(1, axis.n + 1) * (axis.end - axis.start) / axis.n
    near = (coordinates >= location - 0.5 * reso) & (coordinates <= location + 0.5 * reso)
    near[0] = False
    return int(near.argmax()) if near.any() else None


@pytest.mark.parametrize("axis", [R.MODEL_LON, R.MODEL_LAT, R.SpanAxis(10.0, 5.0, 50)])
def test_cell_arithmetic_equals_search(spark, axis):
    rng = random.Random(7)
    low, high = sorted((axis.start, axis.end))
    spots = [rng.uniform(low - 0.2, high + 0.2) for _ in range(6000)]
    spots += [axis.start + (j + 1) * (axis.end - axis.start) / axis.n + s for j in range(axis.n) for s in (-0.025, 0.025)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spots)], "i int, s double")
    reso = 0.05 if axis.n == 140 else 0.3
    got = {i: j for i, j in rows(df.select("i", R.first_match(F.col("s"), axis, reso)))}
    assert [got[i] for i in range(len(spots))] == [searched(axis, s, reso) for s in spots]


def test_box_and_nearest_equal_enumeration(spark):
    rng = random.Random(5)
    cells = [(iy, ix, -21.5 + 0.031 * iy, 55.0 + 0.029 * ix) for iy in range(20) for ix in range(20)]
    spots = [(i, rng.uniform(-21.7, -20.8), rng.uniform(54.8, 55.8)) for i in range(300)]
    stations = spark.createDataFrame(spots, "station_id int, lat double, lon double")
    grid = spark.createDataFrame(cells, "iy int, ix int, lat double, lon double")
    lat_axis, lon_axis = R.axis_vector(grid, "iy", "lat"), R.axis_literal([55.0 + 0.029 * ix for ix in range(20)])
    got = {r["station_id"]: (r["iy"], r["ix"]) for r in R.station_cell_box(stations, lon_axis, lat_axis, 0.05).collect()}
    for i, lat, lon in spots:
        inside = [(iy, ix) for iy, ix, a, o in cells if lat - 0.025 <= a <= lat + 0.025 and lon - 0.025 <= o <= lon + 0.025]
        if inside:
            assert got[i] == min(inside)
        else:
            assert None in got[i]
    bent = [55.0 + 0.029 * ix ** 1.1 for ix in range(20)]
    close = stations.select("station_id", R.nearest_on_axis(F.col("lon"), R.axis_literal(bent), 0.04).alias("j"))
    close = {r["station_id"]: r["j"] for r in close.collect()}
    for i, _, lon in spots:
        best = min((abs(c - lon), ix) for ix, c in enumerate(bent))
        assert close[i] == (best[1] if best[0] <= 0.04 else None)


@pytest.mark.parametrize("bend", [0.0, 0.013])
def test_box_cells_equal_enumeration_on_bent_grids(spark, bend):
    rng = random.Random(8)
    cells = [(iy, ix, -21.5 + 0.031 * iy + bend * ix, 55.0 + 0.029 * ix - bend * iy * iy / 9) for iy in range(20) for ix in range(20)]
    spots = [(i, rng.uniform(-21.7, -20.8), rng.uniform(54.8, 55.8)) for i in range(300)]
    spots += [(300, cells[45][2] + 0.025, cells[45][3] - 0.025), (301, None, 55.0), (302, 0.0, 0.0)]
    stations = spark.createDataFrame(spots, "station_id int, lat double, lon double")
    grid = spark.createDataFrame([(at(t), *c) for c in cells for t in ("2004-11-01", "2004-12-01")],
                                 "time timestamp_ntz, iy int, ix int, lat double, lon double")
    for moment in (None, "2004-12-01"):
        placed = R.grid_cells(grid, moment)
        assert placed.count() == 400
        got = {r["station_id"]: (r["iy"], r["ix"]) for r in R.cell_in_box(stations, placed, 0.05).collect()}
        for i, lat, lon in spots:
            inside = lat is not None and [(iy, ix) for iy, ix, a, o in cells
                                          if lat - 0.025 <= a <= lat + 0.025 and lon - 0.025 <= o <= lon + 0.025]
            assert got.get(i) == (min(inside) if inside else None)


def test_search_on_axes_with_ties_and_ends(spark):
    """Repeated coordinates, falling axes, one entry, locations beyond both ends and on entries."""
    axes = [[1.0, 2.0, 2.0, 3.0, 5.0], [5.0, 4.0, 2.5, 2.5, 0.0], [7.0], [0.5, 0.5]]
    spots = [-9.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.25, 2.5, 3.0, 4.0, 4.5, 5.0, 6.0, 7.0, 99.0]
    df = spark.createDataFrame([(s,) for s in spots], "s double")
    for axis in axes:
        for reach in (0.4, 0.5, 3.0):
            got = rows(df.select("s", R.nearest_on_axis(F.col("s"), R.axis_literal(axis), reach).alias("j"),
                                 R.first_in_box(F.col("s"), R.axis_literal(axis), 2 * reach).alias("k")))
            for s, j, k in got:
                gap, best = min((abs(c - s), i) for i, c in enumerate(axis))
                assert j == (best if gap <= reach else None)
                assert k == min([i for i, c in enumerate(axis) if s - reach <= c <= s + reach], default=None)


def test_stored_cells_read_the_tiles_of_the_stations_only(spark, tmp_path):
    hours = spark.range(24 * 5).select((F.lit("2004-11-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("time"))
    cells = spark.range(20 * 20).select(F.floor(F.col("id") / 20).cast("int").alias("iy"), (F.col("id") % 20).cast("int").alias("ix"))
    grid = hours.crossJoin(cells).withColumn("value", F.hash("time", "iy", "ix").cast("double"))
    path = str(tmp_path / "cells")
    write_cells(grid, path)
    stored = spark.read.parquet(path)
    where = spark.createDataFrame([(1, 3, 3), (2, 3, 2), (3, 17, 9), (4, None, 2), (5, 99, 99), (6, -1, 0)], "station_id int, iy int, ix int")
    found = R.extract_stored(stored, where)
    assert sorted(rows(found)) == sorted(rows(R.extract_at_stations(grid, where)))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    other = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names
             if n.endswith(".parquet") and not d.endswith((f"tile={0}", f"tile={(4 << 20) + 2}"))]
    assert len(other) >= 23
    for name in other:  # whoever reads one of these fails
        with open(name, "w") as f:
            f.write("no parquet")
    assert len(rows(R.extract_stored(stored, where))) == 3 * 24 * 5


def test_unmatched_stations_do_not_fail(spark):
    stations = spark.createDataFrame([(1, 55.5, -21.1), (2, 10.0, 50.0)], "station_id int, lon double, lat double")
    cells = R.station_cell_first(stations)
    assert [r["station_id"] for r in R.unmatched(cells).collect()] == [2]
    iy, ix = next((r["iy"], r["ix"]) for r in cells.collect() if r["station_id"] == 1)
    swapped = R.station_cell_first(stations, swap_axes=True).where("station_id = 1").first()
    assert (swapped["iy"], swapped["ix"]) == (ix, iy)
    grid = spark.createDataFrame([(at("2004-11-01"), iy, ix, 7.0), (at("2004-11-01"), 0, 0, 1.0)],
                                 "time timestamp_ntz, iy int, ix int, value double")
    assert rows(R.extract_at_stations(grid, cells)) == [(1, at("2004-11-01 04:00:00"), 7.0)]


# --- distributions and statistics -----------------------------------------------------------


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_with_a_heavy_group(spark, accuracy):
    rng = np.random.default_rng(2)
    data = {"heavy": np.concatenate([np.zeros(3000), rng.exponential(1e3, 2000), rng.normal(0, 1e-6, 500), [1e200, -1e200]]),
            "light": rng.normal(size=40), "one": np.array([3.0]), "same": np.full(200, 2.5)}
    flat = [(k, float(v)) for k, values in data.items() for v in values] + [("heavy", float("nan")), ("light", None)]
    df = spark.createDataFrame(flat, "k string, v double").repartition(7)
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.25, 0.5, 0.77, 1.0], accuracy).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert got[k]["n"] == len(values)
        assert got[k]["quantiles"] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]), rel=1e-12, abs=1e-15)


def test_quantiles_without_keys(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    for accuracy in (10_000, 10):
        assert Q.exact_quantiles(df, [], "v", [0.5, 0.123], accuracy).first()["quantiles"] == pytest.approx([50.0, 12.3])


def test_box_of_known_values(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0)] + [(2, v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)],
                               "g int, v double")
    one, two = Q.box_stats(df, ["g"], "v").orderBy("g").collect()
    assert (one["q1"], one["median"], one["q3"]) == (1.75, 3.0, 5.0)
    assert (two["whisker_low"], two["whisker_high"], two["outliers"]) == (1.0, 4.0, 1)


@pytest.mark.parametrize("accuracy, strips", [(10_000, 256), (50, 256), (50, 3)])
def test_quantiles_without_keys_by_strips(spark, monkeypatch, accuracy, strips):
    monkeypatch.setattr(Q, "STRIPS", strips)
    rng = np.random.default_rng(6)
    probs = [0.77, 0.0, 0.5, 0.25, 0.1, 1.0, 0.5]
    for values in (np.concatenate([np.zeros(3000), rng.exponential(1e3, 4000), rng.normal(0, 1e-6, 500), [1e308, -1e308]]),
                   rng.integers(0, 5, 4000).astype(float), np.full(300, -2.5), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
        got = Q.exact_quantiles(df, [], "v", probs, accuracy).first()
        assert got["n"] == len(values) and got["quantiles"] == pytest.approx(np.quantile(values, probs), rel=1e-12, abs=1e-15)
    assert Q.exact_quantiles(df.limit(0), [], "v").count() == 0


def test_keyless_values_are_not_ordered_in_one_task(spark):
    df = spark.range(1000).select(F.rand(3).alias("v"))
    plan = Q.box_stats(df, [], "v")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window " in line and "_least" in line:
            assert "_strip" in line.split("windowspecdefinition(")[1].split("_least")[0]


def test_variances(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0)], "station_id int, v double")
    assert S.station_variance(df, ["v"], None).first()["v"] == pytest.approx(np.var([1, 2, 4, 8]))
    got = {r["group"]: r for r in L.group_variation(df.unionByName(df.withColumn("v", F.col("v") * 2).limit(4).withColumn("station_id", F.lit(2))), ["v"], "station_id").collect()}
    assert got["1"]["var_v"] == pytest.approx(np.var([1, 2, 4, 8], ddof=1))
    assert got["overall"]["mean_v"] == pytest.approx((got["1"]["mean_v"] + got["2"]["mean_v"]) / 2)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(4).gamma(2.0, 3.0, 500)
    df = spark.createDataFrame([(float(v), 7.0) for v in values], "a double, b double")
    got = G.histogram(df, ["a", "b"]).orderBy("var", "bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r["n"] for r in got[:10]] == counts.tolist()
    assert [r["left_edge"] for r in got[:10]] == pytest.approx(edges[:-1].tolist())
    assert [r["n"] for r in got[10:]] == np.histogram(np.full(500, 7.0), 10)[0].tolist()


def test_exact_correlation_of_one(spark):
    df = spark.createDataFrame([(at("2005-01-01 10:00:00"), float(i), float(i)) for i in range(4)], "dt timestamp_ntz, x double, y double")
    assert G.corr_by(df, "x", "y", "hour").count() == 1
    assert G.corr_by(df, "x", "y", "hour", drop_exact_one=True).count() == 0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    scaled = L.scaler_fit(df, ["a", "b"]).transform(df)
    values = np.array([1, 2, 4.0])
    assert [r["a"] for r in scaled.orderBy("a").collect()] == pytest.approx(((values - values.mean()) / values.std()).tolist())
    assert {r["b"] for r in scaled.collect()} == {0.0}
    assert {r["b"] for r in L.minmax_scale(df, ["a", "b"]).collect()} == {0.0}


def test_components_and_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    y = 2 + x @ np.array([1.5, -2, 0.5])
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    std = (x - x.mean(0)) / x.std(0)
    want = np.sort(np.linalg.eigvalsh(np.cov(std.T)))[::-1]
    got = [r["variance"] for r in L.pca_variance(df, ["a", "b", "c"]).orderBy("component").collect()]
    assert got == pytest.approx(want.tolist())
    packed = df.select(F.array("a", "b", "c").alias("v"))
    assert [r["variance"] for r in L.pca_variance_vector(packed, "v", 3).orderBy("component").collect()] == pytest.approx(want.tolist())
    terms = {r["term"]: r["coefficient"] for r in L.linear_regression(df, ["a", "b", "c"], "y").collect()}
    assert terms == pytest.approx({"intercept": 2.0, "a": 1.5, "b": -2.0, "c": 0.5})


def test_station_map_with_fixed_bounds(spark):
    df = spark.createDataFrame([(1, -400.0), (2, 10.0)], "station_id int, v double")
    got = rows(S.station_map(df, "v", bounds=(-340.0, 340.0)).select("station_id", "class"), "station_id")
    assert got == [(1, 1), (2, 6)]
