"""Every query by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import decisions, joining, league, ranking, reshaping, resolving, streams


def _modules():
    return (reshaping, joining, ranking, decisions, league, resolving, streams)


def queries() -> dict:
    found: dict = {}
    for module in _modules():
        found |= {name: query for name, (query, _) in module.QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in _modules():
        found |= {name: sql for name, (_, sql) in module.QUERIES.items() if sql}
    return found
