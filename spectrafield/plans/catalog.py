"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from . import forests, gaussian, inference, multivariate, oracle, selection, tuning, windows
from . import queries as q


def queries() -> dict:
    return q.queries() | inference.queries() | multivariate.queries() | selection.queries() | forests.queries() | tuning.queries() | windows.queries() | gaussian.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | inference.oracle_sql() | multivariate.oracle_sql() | selection.oracle_sql() | forests.oracle_sql() | tuning.oracle_sql() | windows.oracle_sql() | gaussian.oracle_sql()
