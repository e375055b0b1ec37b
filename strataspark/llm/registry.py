"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_rules", "simhash", "exact_dedup", "pii", "quality_classifier", "sentencepiece", "lm_scoring", "toxicity", "url_filter", "packing", "alignment", "vector_codes", "warc")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"{__package__}.{module}"), name)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
