"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side is broadcast.
ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
