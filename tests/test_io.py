"""Sources, sinks and the continuous forecast loop on small files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insolara.operators.network import Network
from insolara.operators.stats import Scaler
from insolara.session import cut_lineage, scratch_dir, scratch_path
from insolara.sinks.models import model_name, save_model, save_scaler
from insolara.sinks.text import line_protocol, series_lines, write_parquet
from insolara.sources.grids import grid_long, grid_times_from_start, merge_time
from insolara.sources.models import load_model, load_scaler
from insolara.sources.releases import FILE_FORMAT, forecast_from_folder, forecast_release, newest_release_files, read_release_files
from insolara.sources.stations import read_stations
from insolara.sources.tables import GAPPY_STATIONS, station_query
from insolara.sources.training import read_training, training_features
from insolara.streaming.releases import first_run, release_stream, stream_first_runs, stream_forecast, told_hours
from tests.conftest import at, rows


def test_training_file(spark, tmp_path):
    path = tmp_path / "history.csv"
    path.write_text("DateTime,temp,pv\n03/02/2017 10:00,21.5,300\n04/02/2017 11:00,-99999,200\n"
                    "05/02/2017 12:00,-99999.0,100\n06/12/2017 13:00:00,20,50\n")
    schema = T.StructType([T.StructField("DateTime", T.StringType()), T.StructField("temp", T.DoubleType()),
                           T.StructField("pv", T.DoubleType())])
    got = rows(read_training(spark, str(path), schema, ["temp", "pv", "month", "hour", "season"]), "dt")
    assert got == [(at("2017-02-03 10:00:00"), 21.5, 300.0, 2, 10, 1), (at("2017-12-06 13:00:00"), 20.0, 50.0, 12, 13, 1)]


def test_training_features_with_zenith_and_unknown_column(spark):
    df = spark.createDataFrame([(at("2017-12-06 12:00:00"), 1.0)], "dt timestamp_ntz, temp double")
    assert training_features(df, ["temp", "zenith"]).first()["zenith"] < 10
    with pytest.raises(ValueError):
        training_features(df, ["wind"])


def test_station_layouts(spark, tmp_path):
    new = tmp_path / "new.csv"
    new.write_text("id,longitude,latitude\n97419380, 55.5,-21.1\n")
    assert rows(read_stations(spark, str(new), "model_new")) == [(97419380, None, -21.1, 55.5, None)]
    sat = tmp_path / "sat.csv"
    sat.write_text("id,name,a,b,c,lat,lon,more\n1,x,0,0,0,-21.0,55.0,9\n")
    assert rows(read_stations(spark, str(sat), "satellite")) == [(1, "x", -21.0, 55.0, None)]


def test_station_query_reads_parquet_and_drops_stations(spark, tmp_path):
    path = str(tmp_path / "hourly")
    spark.createDataFrame([(GAPPY_STATIONS[0], 1.0), (5, float("nan"))], "station_id bigint, ssr double").write.parquet(path)
    got = station_query(spark, path, {"station_id": "station_id", "v": "ssr"}, drop_stations=GAPPY_STATIONS)
    assert rows(got) == [(5, None)]


def test_station_query_passes_database_options():
    class Reader:
        def format(self, name):
            self.name = name
            return self

        def options(self, **given):
            self.given = given
            return self

        def load(self):
            raise RuntimeError("loaded")

    class Session:
        read = Reader()

    with pytest.raises(RuntimeError, match="loaded"):
        station_query(Session(), {"url": "jdbc:x", "dbtable": "t", "numPartitions": "4"}, {})
    assert Session.read.name == "jdbc" and Session.read.given["numPartitions"] == "4"


def _release_file(folder, stamp, release, kelvin, mtime):
    path = folder / FILE_FORMAT.format(hour=stamp, release=release)
    path.write_text("\n".join(["x"] * 10 + [str(kelvin), "end"]))
    os.utime(path, (mtime, mtime))


def test_forecast_release_stops_at_first_gap(spark, tmp_path):
    start = at("2020-01-01 06:00:00")
    for i in range(24):
        _release_file(tmp_path, (start + dt.timedelta(hours=i)).strftime("%Y%m%d%H"), 1, 290.0, 1_000_000)
    for i in range(10):
        if i != 7:
            _release_file(tmp_path, (start + dt.timedelta(hours=i)).strftime("%Y%m%d%H"), 2, 300.0 + i, 2_000_000 + i)
    files = read_release_files(spark, str(tmp_path / FILE_FORMAT.format(hour="*", release="*")))
    got = rows(forecast_release(files, "2020-01-01 06:40:00"), "dt")
    assert [r[1] for r in got] == [start + dt.timedelta(hours=i) for i in range(7)]
    assert {r[0] for r in got} == {2}
    assert got[0][2] == 26.5


def test_forecast_from_a_folder_opens_the_wanted_files_only(spark, tmp_path):
    start = at("2020-01-01 00:00:00")
    for release in (1, 2, 3):
        for i in range(60):
            if (release, i) != (3, 20):
                stamp = (start + dt.timedelta(hours=i)).strftime("%Y%m%d%H")
                _release_file(tmp_path, stamp, release, 280.0 + release + i / 10, 1_000_000 * release + i)
    (tmp_path / "notes.txt").write_text("other")
    for now, count in (("2020-01-01 05:30:00", 24), ("2020-01-02 20:00:00", 16), ("2020-01-01 20:10:00", 24)):
        files = newest_release_files(spark, str(tmp_path), now)
        assert len(files.inputFiles()) <= 24 and files.count() <= count
        assert all("release_3" in f for f in files.inputFiles())
        whole = forecast_release(read_release_files(spark, str(tmp_path / FILE_FORMAT.format(hour="*", release="*"))), now)
        assert rows(forecast_from_folder(spark, str(tmp_path), now), "dt") == rows(whole, "dt")
    assert forecast_from_folder(spark, str(tmp_path), "2021-01-01").count() == 0


def test_forecast_release_without_current_hour_is_empty(spark, tmp_path):
    _release_file(tmp_path, "2020010108", 3, 290.0, 1_000_000)
    files = read_release_files(spark, str(tmp_path / "*.xml"))
    assert rows(forecast_release(files, "2020-01-01 06:40:00")) == []


def test_streamed_releases(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    _release_file(folder, "2020010106", 1, 290.0, 1_600_000_000)
    _release_file(folder, "2020010107", 1, 291.0, 1_600_000_001)
    for _ in range(2):
        stream = release_stream(spark, str(folder))
        query = stream_forecast(stream, lambda df: df.withColumn("pv", F.col("temp") * 2), "pv", "pv", out, state,
                                zone="UTC")
        query.awaitTermination(120)
        _release_file(folder, "2020010108", 1, 292.0, 1_600_000_002)
    lines = sorted(r[0] for r in spark.read.text(f"{out}/batch=*").collect())
    assert len(lines) == 3
    assert lines[0] == 'pv date_concerned="2020-01-01 06:00:00",pv=33.000 1577858400000000000'


def test_line_formats(spark):
    df = spark.createDataFrame([(7, at("2004-11-01 04:00:00"), 1.23456)], "station_id bigint, dt timestamp_ntz, v double")
    assert rows(series_lines(df, "v")) == [("7,2004-11-01 04:00:00,1.2346",)]
    want = 'pv date_concerned="2004-11-01 04:00:00",ssr=1.235 1099267200000000000'
    assert rows(line_protocol(df, "pv", "v", name="ssr")) == [(want,)]


def test_parquet_layout_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(at(f"2005-{m:02d}-01 00:00:00"), float(m)) for m in range(1, 13)],
                               "dt timestamp_ntz, v double")
    write_parquet(df, path)
    back = spark.read.parquet(path).where("month = 3")
    assert [r["v"] for r in back.collect()] == [3.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_models_round_trip(spark, tmp_path):
    net = Network.create(3, (6, 4), "tanh", 1)
    path = save_model(spark, net, str(tmp_path), "best", 0.91234)
    assert path.endswith("best-3-6-4-1-tanh-r2-0.912")
    loaded = load_model(spark, path)
    assert loaded.sizes == net.sizes and (loaded.flat() == net.flat()).all()
    assert model_name("m", Network.create(2, (5, 5)), 0.5) == "m-2-5-5-1-relu-r2-0.500"
    save_scaler(spark, Scaler(["a"], [1.0], [2.0]), str(tmp_path / "s"))
    assert load_scaler(spark, str(tmp_path / "s")) == Scaler(["a"], [1.0], [2.0])


def test_grid_long_and_times(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]]), (5, [[5.0, 6.0], [7.0, 8.0]])],
                               "step int, values array<array<double>>")
    timed = grid_times_from_start(df, "2004-10-15 00:00:00")
    got = rows(grid_long(timed, [-21.0, -20.0], [55.0, 56.0]), "time", "iy", "ix")
    assert got[1] == (at("2004-10-15 00:00:00"), 0, 1, -21.0, 56.0, 2.0)
    assert got[-1] == (at("2004-10-15 05:00:00"), 1, 1, -20.0, 56.0, 8.0)
    swapped = rows(grid_long(timed, [-21.0, -20.0], [55.0, 56.0], swap_axes=True), "time", "iy", "ix")
    assert swapped[1] == (at("2004-10-15 00:00:00"), 0, 1, -21.0, 56.0, 3.0)


def test_merge_keeps_the_first_file(spark):
    data = [(f, at(f"2005-01-01 0{h}:00:00"), 0, 0, "u", float(10 * f + h)) for f in (1, 2) for h in range(f, f + 3)]
    df = spark.createDataFrame(data, "file_seq int, time timestamp_ntz, iy int, ix int, var string, value double")
    assert [r[-1] for r in rows(merge_time(df), "time")] == [11.0, 12.0, 13.0, 24.0]


def test_scratch_folder(spark):
    assert scratch_path(spark, "x").startswith(scratch_dir(spark))
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_first_runs_go_on_after_a_restart(spark, tmp_path):
    """Gaps that close late, replaced values, hours outside and missing values; two runs of one checkpoint."""
    start = at("2020-01-01 00:00:00")
    schema = "release bigint, dt timestamp_ntz, kelvin double, modified timestamp_ntz"

    def file_rows(number, hours, release=1, kelvin=280.0):
        spark.createDataFrame([(release, start + dt.timedelta(hours=h), kelvin + h if kelvin else None, start + dt.timedelta(minutes=number))
                               for h in hours], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_first_runs(first_run(stream, "2020-01-01", 6), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(rows(told_hours(spark, str(tmp_path / "out"), "2020-01-01", 273.5)))

    def wanted(release, values):
        return [(release, start + dt.timedelta(hours=h), v) for h, v in enumerate(values)]

    file_rows(1, [0, 1, 3, -2])
    file_rows(2, [1, 2], release=2)
    assert run() == wanted(1, [6.5, 7.5])
    file_rows(3, [2, 9])
    file_rows(4, [1], kelvin=290.0)
    file_rows(5, [4], kelvin=None)
    file_rows(0, [0], kelvin=250.0)  # older than what is known
    assert run() == wanted(1, [6.5, 17.5, 8.5, 9.5])
    file_rows(6, [0], release=2)
    assert run() == wanted(1, [6.5, 17.5, 8.5, 9.5]) + wanted(2, [6.5, 7.5, 8.5])
    assert run() == wanted(1, [6.5, 17.5, 8.5, 9.5]) + wanted(2, [6.5, 7.5, 8.5])  # nothing new
