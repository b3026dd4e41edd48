"""All queries of the terrain operators and their SQL."""

from __future__ import annotations

from terrasol.plans import focal_queries, grid_queries, patch_queries, several_grids, window_queries  # noqa: F401  (they register their queries)
from terrasol.plans.register import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
