"""Names of the registered queries and the modules that bring them."""

from __future__ import annotations

from collections.abc import Callable


def _modules() -> list:
    from . import log_queries, report_queries, source_queries, study_queries, text_queries, unit_queries, unit_study_queries

    return [unit_queries, study_queries, text_queries, report_queries, log_queries, source_queries, unit_study_queries]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.SQL
    return out
