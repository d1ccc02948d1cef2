"""Broadcast only behind a size check.

``bounded(df, max_rows)`` counts the rows of a would-be broadcast side (one
small job) and returns ``F.broadcast(df)`` only under the bound; above it the
plain DataFrame is returned and the planner keeps a shuffle join.  Sides that
are bounded by construction (fixed rule tables, one-row aggregates) are
broadcast directly at their call sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 200_000


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
