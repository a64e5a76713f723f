"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast.
SMALL = 10_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
