"""Physical plans: what reaches the scan, which joins and evaluations appear."""

import pytest
from pyspark.sql import functions as F

from insolara.functions import solar
from insolara.operators import grid as R
from insolara.operators.filters import hour_range, time_range
from insolara.operators.stations import completeness, missing_steps
from insolara.plans import PLANS
from insolara.plans import views as V


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas")
PYTHON_QUERIES = ("gmm", "mlp", "pca_variance_vector", "cluster_")


@pytest.mark.parametrize("name", [n for n in PLANS if not n.startswith(PYTHON_QUERIES) and n not in (
    "read_training", "read_stations", "write_series_csv", "write_parquet", "save_load_scaler")])
def test_queries_stay_in_the_jvm_and_avoid_nested_loops(spark, sf_dir, name):
    plan = text(PLANS[name].build(spark, sf_dir))
    for bad in (*NO_PYTHON, "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, f"{name}: {bad}"


def test_time_bounds_reach_the_scan(spark, sf_dir):
    plan = text(PLANS["verify_by_station"].build(spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in plan and "LessThan(ts,2024-01-29T00:00)" in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split(">")[0]


def test_stored_table_filters_are_pushed(spark, sf_dir):
    rows = hour_range(time_range(V.table(spark, sf_dir, "events"), "2024-01-05", "2024-01-06", "ts"), dt="ts")
    plan = text(rows.select("value"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_station_extraction_is_one_equi_join(spark, sf_dir):
    cells = R.station_cell_nearest(V.station(spark, sf_dir), R.Axis(55.0, 0.1, 10), R.Axis(-21.6, 0.1, 10))
    plan = text(R.extract_at_stations(V.grid(spark, sf_dir), cells, ["p"]))
    assert plan.count("BroadcastHashJoin") == 1


def test_completeness_shuffles_day_masks_only(spark, sf_dir):
    for made in (completeness(V.station_hour(spark, sf_dir)), missing_steps(V.station_hour(spark, sf_dir))):
        plan = text(made)
        assert "partial_bit_or" in plan and "NestedLoop" not in plan


def test_zenith_is_generated_code(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(solar.solar_zenith(F.col("ts")).alias("z"))
    assert not any(p in text(rows) for p in NO_PYTHON)
