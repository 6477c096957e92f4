"""Windowed features over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.operators.events import WINDOW, densify, feature_aggregates
from fleetsight.schemas import EVENT_COUNTS


def in_open_windows(
    events: DataFrame, window: str = WINDOW, watermark: str = "10 seconds", ts: str = "ts"
) -> DataFrame:
    """Of a stored table of events, those in windows that a stream over it leaves open at its end.

    A stream emits a window once the watermark has passed it, so a bounded run keeps back its last
    ones. The functions below, applied to these events in batch, give the missing rows.
    """
    last = events.agg(F.max(ts)).first()[0]
    closed = F.lit(last) - F.expr(f"INTERVAL '{watermark}'")
    return events.where(F.window(ts, window)["end"] > closed)


def complete_dense(dense: DataFrame, still_open: DataFrame, window: str = WINDOW) -> DataFrame:
    """Zero-filled features of a bounded run: the output of ``stream_densify`` with each late row in
    place of the zero row of its window, the features of the windows left open (``still_open``), and
    the zero rows of silent nodes up to the last window of all.
    """
    counts = F.max_by(F.struct(*EVENT_COUNTS), "late").alias("_counts")
    settled = dense.groupBy("node", "window_start").agg(counts)
    settled = settled.select("node", "window_start", "_counts.*")
    return densify(settled.unionByName(still_open), window)


def stream_event_features(
    events: DataFrame, window: str = WINDOW, watermark: str = "10 seconds", ts: str = "ts"
) -> DataFrame:
    """Per-node window features, emitted once the watermark passes a window's end.

    Two chained aggregations: by (node, window, binary) first, then by (node, window). The
    distinct count is then a plain count over unique binaries: exact (streams reject
    ``count_distinct``), without a growing set per node, and a busy node is spread over tasks.
    """
    is_exec = F.col("event_class") == "exec"
    aggs = feature_aggregates()
    per_binary = (
        events.withWatermark(ts, watermark)
        .withColumn("_binary", F.when(is_exec, F.col("binary")))
        .groupBy(F.window(ts, window).alias("w"), "node", "_binary")
        .agg(*[a.alias(n) for n, a in aggs.items()])
    )
    return (
        per_binary.groupBy(F.window(F.window_time("w"), window).alias("w2"), "node")
        .agg(
            F.count("_binary").alias("unique_process_count"),
            *[F.sum(n).alias(n) for n in aggs],
        )
        .select("node", F.col("w2.start").alias("window_start"), *EVENT_COUNTS)
    )


def stream_kind_counts(
    events: DataFrame, window: str = WINDOW, watermark: str = "10 seconds", ts: str = "ts"
) -> DataFrame:
    """Histogram rows (node, window_start, kind, n) of closed windows."""
    return (
        events.withWatermark(ts, watermark)
        .where(F.col("event_class").isNotNull())
        .groupBy(F.window(ts, window).alias("w"), "node", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("node", F.col("w.start").alias("window_start"), "kind", "n")
    )
