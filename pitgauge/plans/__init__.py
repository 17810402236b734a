"""Named queries, grouped by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["panel_plans", "profile_plans", "score_plans", "scenario_plans", "contract_plans", "quality_plans", "check_plans", "evaluation_plans", "model_plans", "spatial_plans", "stream_plans", "store_plans"]


def load_all():
    """Import every family and return the filled registry module."""
    for family in FAMILIES:
        import_module(f"pitgauge.plans.{family}")
    return import_module("pitgauge.plans.registry")
