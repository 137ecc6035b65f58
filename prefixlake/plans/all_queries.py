"""Collects the registered queries of every plan module."""

from __future__ import annotations

from prefixlake.plans import analytics_plans, function_plans, ingest_plans, lookup_plans, pipeline_plans, search_plans, source_plans  # noqa: F401
from prefixlake.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
