"""Verification scores as aggregate Columns, usable in any ``groupBy().agg()``.

Only rows where both sides are present take part in a score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insolara.functions import columns as C


def paired(first: Column, second: Column) -> tuple[Column, Column]:
    both = first.isNotNull() & second.isNotNull()
    return F.when(both, first), F.when(both, second)


def mean_bias(model: Column, observed: Column) -> Column:
    return F.avg(model - observed)


def mae(model: Column, observed: Column) -> Column:
    return F.avg(F.abs(model - observed))


def rmse(model: Column, observed: Column) -> Column:
    miss = model - observed
    return F.sqrt(F.avg(miss * miss))


def r2(model: Column, observed: Column, truth: str = "model") -> Column:
    """1 - SSE/SST; ``truth`` names the side whose spread is the yardstick."""
    if truth not in ("model", "obs"):
        raise ValueError("truth must be 'model' or 'obs'")
    m, o = paired(model, observed)
    yardstick = m if truth == "model" else o
    miss = model - observed
    return F.lit(1.0) - F.try_divide(F.sum(miss * miss), F.count(yardstick) * F.var_pop(yardstick))


def correlation(first: Column, second: Column) -> Column:
    """Pearson r; NULL for a constant side (the built-in raises under ANSI)."""
    a, b = paired(first, second)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def verification(model: Column, observed: Column, truth: str = "model") -> dict[str, Column]:
    return {
        "mean_bias": mean_bias(model, observed),
        "r2": r2(model, observed, truth),
        "mae": mae(model, observed),
        "rmse": rmse(model, observed),
        "corr": correlation(model, observed),
    }


def forecast(predicted: Column, observed: Column) -> dict[str, Column]:
    """RMSE, MAE and their range-normalised forms, MAPE and hit rates, all in percent where relative."""
    p, o = paired(predicted, observed)
    spread = F.max(o) - F.min(o)
    return {
        "n": F.count(p),
        "rmse": rmse(p, o),
        "mae": mae(p, o),
        "nrmse": F.try_divide(rmse(p, o), spread) * 100.0,
        "nmae": F.try_divide(mae(p, o), spread) * 100.0,
        "mape": F.avg(F.try_divide(F.abs(p - o), o)) * 100.0,
        "hit5": F.avg(C.hit(o, p, 0.05).cast("double")),
        "hit8": F.avg(C.hit(o, p, 0.08).cast("double")),
    }


def regression_bic(observed: Column, predicted: Column, params: int) -> Column:
    """n ln(SSE/n) + p ln n."""
    o, p = paired(observed, predicted)
    miss = o - p
    n = F.count(miss).cast("double")
    return n * F.ln(F.try_divide(F.sum(miss * miss), n)) + F.lit(float(params)) * F.ln(n)
