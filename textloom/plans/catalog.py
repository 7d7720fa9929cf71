"""All queries of the engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import further, more, records, registry, runs, state


def queries() -> dict[str, registry.Query]:
    return registry.queries() | more.queries() | records.queries() | runs.queries() | state.queries() | further.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql() | more.oracle_sql() | records.oracle_sql() | runs.oracle_sql() | state.oracle_sql() | further.oracle_sql()
