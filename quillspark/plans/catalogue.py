"""Registered queries of the retrieval and evaluation operators, with their SQL."""

from __future__ import annotations

from quillspark.plans import evaluation, retrieval

_MODULES = (retrieval, evaluation)


def queries() -> dict:
    """Query functions of (spark, sf_dir) by name."""
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
