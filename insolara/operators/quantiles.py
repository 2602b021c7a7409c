"""Exact quantiles and box statistics that hold for groups of any size, in one way.

A first pass counts each group and brackets every wanted rank between two values of
a quantile sketch. A second pass counts what lies below each bracket and the few
distinct values inside it; the rank is then found among those. Whatever the size or
skew of a group, both passes combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insolara.functions.nulls import present
from insolara.operators.reshape import join_groups

QUARTILES = (0.25, 0.5, 0.75)
ACCURACY = 10_000
STRIPS = 256  # parts of a bracket that are ranked side by side where there are no keys


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = QUARTILES,
                    accuracy: int = ACCURACY) -> DataFrame:
    """``keys, n, quantiles``: linear-interpolated quantiles of each group, as an array.

    ``accuracy`` is that of the sketch: a larger one leaves fewer values between its brackets, the
    result is exact with any.
    """
    rows = df.select(*keys, present(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    shares = [min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(s) for s in shares]), accuracy).alias("_s")).where(F.col("n") > 0)
    brackets = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("n") - 1)
        # groups of few rows are listed whole, ranks near the ends of others from their extremes
        few, near_end = F.col("n") <= 2 * accuracy, F.col("n") * margin * 2 + 2
        low = F.when(few | (spot <= near_end), F.col("_min")).otherwise(F.col("_s")[2 * i])
        high = F.when(few | (spot >= F.col("n") - near_end), F.col("_max")).otherwise(F.col("_s")[2 * i + 1])
        brackets.append(F.struct(spot.alias("spot"), low.alias("lo"), high.alias("hi")))
    bounds = sketch.select(*keys, "n", F.array(*brackets).alias("_b"))
    if keys:
        near = join_groups(rows, bounds, keys)
    else:
        near = rows.withColumn("_f", bounds.select(F.struct("n", "_b").alias("f")).scalar()).select(
            "_v", F.col("_f.n").alias("n"), F.col("_f._b").alias("_b"))
    within = F.exists("_b", lambda b: F.col("_v").between(b["lo"], b["hi"]))
    # values outside all brackets only need counting: they fall together between the brackets' ends
    place = F.when(within, F.col("_v"))
    gap = F.when(~within, F.aggregate("_b", F.lit(0), lambda a, b: a + F.when(F.col("_v") > b["hi"], 1).otherwise(0)))
    counts = near.groupBy(*keys, "n", "_b", place.alias("_v"), gap.alias("_gap")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"))
    running = _running(counts, keys).where(F.col("_v").isNotNull())
    spots = F.transform("_b", lambda b: b["spot"])
    picked = running.groupBy(*keys, "n", spots.alias("_spots")).agg(*[
        _at_rank(i, side).alias(f"_q{i}{side}") for i in range(len(probs)) for side in ("floor", "ceil")])
    values = []
    for i in range(len(probs)):
        spot, under, over = F.col("_spots")[i], F.col(f"_q{i}floor"), F.col(f"_q{i}ceil")
        values.append(under + (over - under) * (spot - F.floor(spot)))
    return picked.select(*keys, "n", F.array(*values).alias("quantiles"))


def _running(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows up to and with each value, as ``_upto``.

    With keys each group is ordered by itself. Without, all values would be one task's: they are put into
    strips of their bracket, whose numbers rise with the value. The strips' sums, at most STRIPS + 2 per
    wanted rank, give what lies below each strip, and only a strip is ordered in one task.
    """
    if keys:
        return counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_least")))
    ends = F.array_sort(F.transform("_b", lambda b: F.struct(b["hi"].alias("hi"), b["lo"].alias("lo"))))
    passed = F.size(F.filter("_ends", lambda b: b["hi"] < F.col("_least")))
    low, high = F.get("_ends", F.col("_passed"))["lo"], F.get("_ends", F.col("_passed"))["hi"]
    share = F.when(high > low, (F.col("_least") / 2 - low / 2) / (high / 2 - low / 2)).otherwise(0.0)
    within = F.when(low <= F.col("_least"), F.floor(share * STRIPS).cast("int") + 1)
    placed = (counts.withColumn("_ends", ends).withColumn("_passed", passed)
              .withColumn("_strip", F.col("_passed") * (STRIPS + 2) + F.coalesce(within, F.lit(0))).drop("_ends", "_passed"))
    sums = placed.groupBy("_strip").agg(F.sum("_c").alias("_sum"))
    below = sums.select("_strip", (F.sum("_sum").over(Window.orderBy("_strip")) - F.col("_sum")).alias("_below"))
    inside = F.sum("_c").over(Window.partitionBy("_strip").orderBy("_least"))
    return placed.join(F.broadcast(below), "_strip").withColumn("_upto", F.col("_below") + inside)


def _at_rank(i: int, side: str) -> Column:
    """The least value up to which more rows lie than the rank (from 0) below or above the i-th spot."""
    rank = getattr(F, side)(F.col("_b")[i]["spot"])
    return F.min(F.when(F.col("_upto") > rank, F.col("_v")))


def approximate_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = QUARTILES,
                          accuracy: int = 10000) -> DataFrame:
    """Sketch-based quantiles in one pass, for when a small rank error is acceptable."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    rows = df.select(*keys, present(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"),
                                   F.percentile_approx("_v", wanted, accuracy).alias("quantiles"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, outlier count and mean per group."""
    rows = df.select(*keys, present(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    made = (exact_quantiles(rows, keys, "_v") if exact
            else approximate_quantiles(rows, keys, "_v"))
    q1, q2, q3 = (F.col("quantiles")[i] for i in range(3))
    fences = made.select(*keys, q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
                         (q1 - 1.5 * (q3 - q1)).alias("_low"), (q3 + 1.5 * (q3 - q1)).alias("_high"))
    names = ["q1", "median", "q3", "_low", "_high"]
    if keys:
        near = join_groups(rows, fences, keys)
    else:
        packed = fences.select(F.struct(*names).alias("f")).scalar()
        near = rows.withColumn("_f", packed).select("_v", *[F.col(f"_f.{n}").alias(n) for n in names])
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    return near.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
