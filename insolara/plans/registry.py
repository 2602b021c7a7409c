"""Registry of named analyses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.nulls import floating_columns
from insolara.plans.views import VIEW_SQL

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    build: Build
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` states the same result for a plain SQL engine."""

    def register(build: Build) -> Build:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = Plan(name, build, sql)
        return build

    return register


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round floating columns so that results can be compared between engines.

    A nudge far below the last digit sends exact halves the same way everywhere;
    adding zero turns -0.0 into 0.0.
    """
    def rounded(name: str) -> Column:
        places = special.get(name, digits)
        return F.round(F.col(name) + F.lit(10.0 ** -(places + 3)), places) + F.lit(0.0)

    return df.withColumns({c: rounded(c) for c in floating_columns(df)})


def r(expr: str, digits: int = 6) -> str:
    """The SQL form of :func:`tidy` for one expression."""
    return f"(round({expr} + 1e-{digits + 3}, {digits}) + 0.0)"


def with_views(body: str, *views: str) -> str:
    """``body`` behind the definitions of the views it reads (dependencies first)."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in VIEW_SQL[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for view in views:
        need(view)
    if not needed:
        return body
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v][1]})" for v in needed)
    stripped = body.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if stripped.upper().startswith(opening):
            return f"{opening}{ctes}, {stripped[len(opening):]}"
    return f"WITH {ctes} {stripped}"


def corr_sql(a: str, b: str) -> str:
    """Pearson r that is NULL for a constant side."""
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
