"""The queries of the reference's own operators and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("strataspark.plans.reference_queries", "strataspark.plans.volume_queries", "strataspark.plans.well_queries", "strataspark.plans.cube_queries", "strataspark.plans.interval_queries", "strataspark.plans.file_queries", "strataspark.plans.rock_queries")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(module), name)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
