"""Derived value columns: differences, ratios, units, classes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants, and the divergent ones needed for parity runs.
DAY_SECONDS = 86400.0
PARITY_DAY_SECONDS = 85400.0
KELVIN_OFFSET = 273.15
PARITY_KELVIN_OFFSET = 273.5

# Contour levels as (first level, last level, step).
CONTOURS = {
    "pressure": (98947.0, 102247.0, 300.0),
    "zonal_wind": (-10.0, 10.0, 2.0),
    "cloud_hourly": (60.0, 100.0, 2.0),
    "cloud_mean": (60.0, 80.0, 2.0),
}


def bias(model: Column, observed: Column) -> Column:
    return model - observed


def abs_diff(first: Column, second: Column) -> Column:
    return F.abs(first - second)


def ratio(model: Column, observed: Column) -> Column:
    """NULL where the observation is zero."""
    return F.try_divide(model, observed)


def flux_from_accumulated(energy: Column, seconds: float = DAY_SECONDS) -> Column:
    return energy / F.lit(float(seconds))


def kelvin_to_celsius(kelvin: Column, offset: float = KELVIN_OFFSET, digits: int = 3) -> Column:
    return half_even(kelvin - F.lit(float(offset)), digits)


def half_even(value: Column, digits: int) -> Column:
    """Round with ties to the even neighbour."""
    return F.bround(value, digits)


def nice_step_digits(low: Column, high: Column) -> Column:
    return F.when(high - low < 10, F.lit(2)).otherwise(F.lit(0))


def nice_bounds(low: Column, high: Column, n: int = 10, symmetric: bool = False) -> tuple[Column, Column]:
    """Bounds that split into ``n`` readable classes; around zero for a bias."""
    narrow = high - low < 10

    def settle(edge: Column) -> Column:
        part = edge / F.lit(float(n))
        return F.when(narrow, half_even(part, 2)).otherwise(half_even(part, 0)) * F.lit(float(n))

    lo, hi = settle(low), settle(high)
    if symmetric:
        reach = F.greatest(F.abs(lo), F.abs(hi))
        return -reach, reach
    return lo, hi


def value_class(value: Column, low: Column | float, high: Column | float, n: int = 10) -> Column:
    """Class 1..n of ``value`` between two bounds; values outside join the edge class."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    share = F.try_divide(value - lo, hi - lo)
    place = F.floor(share * F.lit(float(n))) + 1
    inside = F.least(F.greatest(place, F.lit(1)), F.lit(n)).cast("int")
    return F.when(lo < hi, inside).when(value.isNotNull() & (lo == hi), F.lit(1))


def contour_class(value: Column, low: float, high: float, step: float) -> Column:
    """Number of the contour band, counted from 0; NULL outside the levels."""
    band = F.floor((value - F.lit(float(low))) / F.lit(float(step))).cast("int")
    last = int(round((high - low) / step)) - 1
    return F.when(value.between(float(low), float(high)), F.least(band, F.lit(last)))


def fixed_text(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def two_digit(value: Column) -> Column:
    return F.format_string("%02d", value)


def error(observed: Column, predicted: Column) -> Column:
    return predicted - observed


def hit(observed: Column, predicted: Column, tolerance: float) -> Column:
    """Within a share of the observation; a negative observation is never hit."""
    return F.abs(observed - predicted) <= observed * F.lit(float(tolerance))
