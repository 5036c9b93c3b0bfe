"""All queries of the core and their SQL."""

from __future__ import annotations

from arborlake.plans import dealt, flatmaps, morphology

PARTS = [dealt, morphology, flatmaps]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
