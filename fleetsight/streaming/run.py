"""Starting, bounding and publishing streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight.operators.trust import latest_state
from fleetsight.sinks.tables import publish_state


def stream_to_table(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append"
) -> StreamingQuery:
    """Exactly-once Parquet file sink."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def stream_state(
    trace: DataFrame,
    path: str,
    checkpoint: str,
    order: tuple[str, ...] = ("last_seen",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish the current state after every micro-batch (K4). ``trace`` has the snapshot
    columns plus, optionally, tie-breaking order columns."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        publish_state(latest_state(batch, order=order), batch_id, path)

    return (
        trace.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_actions(
    trace: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append fired actions to the action log."""
    return stream_to_table(trace.where(F.col("action").isNotNull()), path, checkpoint, trigger)


def run_bounded(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Wait for a query: to its end when ``seconds`` is None (availableNow), else stop it after
    that long. True when it ended by itself."""
    if seconds is None:
        query.awaitTermination()
        return True
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
