"""Registry of the queries over the driver's tables and of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that DuckDB runs against it."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


for _module in ("track_queries", "raster_queries", "match_queries", "geometry_queries", "text_queries", "more_queries", "stereo_queries", "registration_queries", "assembly_queries", "file_queries"):
    import_module(f"selenite.plans.{_module}")
