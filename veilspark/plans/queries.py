"""All named queries of the library and their DuckDB SQL."""

from __future__ import annotations

from . import analytics, detection, pipeline, runs, scalars  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
