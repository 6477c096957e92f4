"""Broadcast decisions backed by a known row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we ever force to every executor. Rows here are a few dozen bytes wide.
BROADCAST_ROW_LIMIT = 500_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint ``df`` for broadcast when its *known* row count is within ``limit``.

    Beyond the limit the frame is returned unhinted, so Catalyst/AQE plan a shuffled join
    (with run-time skew splitting) instead.
    """
    return F.broadcast(df) if rows <= limit else df


def count_up_to(df: DataFrame, limit: int) -> int:
    """Row count of ``df``, but never reading past ``limit + 1`` rows."""
    return df.limit(limit + 1).count()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a batch frame with too few input splits over the cores before heavy row work.

    A large table comes in many splits and passes through untouched. Hashing by ``keys`` (which
    should identify rows) keeps the placement the same when a task is run again.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys)
