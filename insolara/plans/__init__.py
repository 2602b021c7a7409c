"""Registered analyses over the standard tables, each with its SQL counterpart."""

from insolara.plans import (  # noqa: F401 - importing registers the queries
    align_plans,
    column_plans,
    diurnal_plans,
    filter_plans,
    grid_plans,
    io_plans,
    model_plans,
    station_plans,
)
from insolara.plans.registry import PLANS, Plan

__all__ = ["PLANS", "Plan"]
