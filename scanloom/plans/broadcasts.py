"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows (a few numbers each) up to this many are small enough for every executor.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than `most` rows, else as it is, for a shuffled join. df should be
    cheap to read twice, such as a checkpoint, and narrow."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
