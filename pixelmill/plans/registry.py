"""Name -> query and name -> DuckDB text, gathered from the plan modules."""

from __future__ import annotations

from . import pixel_queries, pixel_sql, table_queries

QUERIES: dict = {**pixel_queries.QUERIES, **table_queries.QUERIES}
ORACLES: dict = {**pixel_sql.ORACLES, **table_queries.ORACLES}
