"""All queries of the core and their oracles."""

from __future__ import annotations

from dotframe.plans import general, reference

_MODULES = (general, reference)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
