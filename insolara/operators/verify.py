"""Scores of predictions against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions import scores
from insolara.functions.nulls import inf_to_null
from insolara.operators.align import hour_profile_join
from insolara.operators.reshape import with_position


def verify_by_station(df: DataFrame, model: str, observed: str, truth: str = "model",
                      by: Sequence[str | Column] = ("station_id",)) -> DataFrame:
    """Mean bias, R2, MAE, RMSE and correlation per station in one aggregation."""
    made = scores.verification(F.col(model), F.col(observed), truth)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])


def forecast_scores(df: DataFrame, predicted: str, observed: str, by: Sequence[str | Column] = ()) -> DataFrame:
    made = scores.forecast(F.col(predicted), F.col(observed))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])


def hourly_uncertainty(df: DataFrame, predicted: str, observed: str, dt: str = "dt") -> DataFrame:
    """Per hour: mean observation and prediction, MAE, distance of the means; the mean distance and day count beside.

    Rows are first reduced to one per day and hour; whatever follows is small.
    """
    p, o = F.col(predicted), F.col(observed)
    per_day = df.groupBy(F.to_date(dt).alias("_day"), F.hour(dt).alias("hour")).agg(
        F.sum(o).alias("_so"), F.count(o).alias("_no"), F.sum(p).alias("_sp"), F.count(p).alias("_np"),
        F.sum(F.abs(p - o)).alias("_sa"), F.count(p - o).alias("_na"))
    hourly = per_day.groupBy("hour").agg(
        F.try_divide(F.sum("_so"), F.sum("_no")).alias("mean_obs"),
        F.try_divide(F.sum("_sp"), F.sum("_np")).alias("mean_pred"),
        F.try_divide(F.sum("_sa"), F.sum("_na")).alias("mae"))
    hourly = hourly.withColumn("mean_error", F.abs(F.col("mean_pred") - F.col("mean_obs")))
    overall = F.avg("mean_error").over(Window.partitionBy())  # 24 rows
    days = df.where(o.isNotNull()).select(F.to_date(dt).alias("d")).distinct().agg(F.count("*")).scalar()
    return hourly.withColumns({"overall_error": overall, "days": days})


def error_columns(df: DataFrame, predicted: str, observed: str, dt: str = "dt") -> DataFrame:
    """Error, absolute and relative error (by the hourly mean observation) and hits within 5 and 8 percent."""
    p, o = F.col(predicted), F.col(observed)
    rows = hour_profile_join(df, [observed], dt)
    relative = inf_to_null(F.try_divide(p - o, F.col(f"{observed}_hour_mean")))
    return rows.withColumns({
        "error": C.error(o, p), "abs_error": F.abs(C.error(o, p)), "rel_error": relative,
        "hit5": C.hit(o, p, 0.05), "hit8": C.hit(o, p, 0.08)})


def error_series(df: DataFrame, predicted: str, observed: str, dt: str = "dt", first_day: bool = False) -> DataFrame:
    """``position, obs, pred`` in time order, all days or the first 24 steps."""
    rows = with_position(df.select(dt, predicted, observed), dt)
    if first_day:
        rows = rows.where(F.col("position") < 24)
    return rows.select("position", F.col(observed).alias("obs"), F.col(predicted).alias("pred"))
