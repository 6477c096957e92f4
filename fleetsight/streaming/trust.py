"""Trust over streams, micro-batch by micro-batch with the batch operator.

The published snapshot is the state: each micro-batch starts every node from its score in the
previous snapshot. A busy node is cut into chunks exactly as in batch, results are written under
the batch id, and a replayed batch overwrites its own output, so restarts change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight.jobs.detect import LIVE_THRESHOLD, Scorer, verify_and_score
from fleetsight.operators.trust import (
    V1,
    TrustPolicy,
    latest_state,
    status_transitions,
    trust_scores,
)
from fleetsight.plans.kept import kept, settled
from fleetsight.sinks.tables import publish_state, state_before
from fleetsight.streaming.steps import State, Step


def trust_batch(
    batch: DataFrame,
    prior: DataFrame | None,
    policy: TrustPolicy = V1,
    order: Sequence[str] = ("ts",),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Trust trace of one micro-batch, going on from the prior snapshot."""
    names = {}
    if prior is not None:
        start = prior.select(
            "node",
            F.col("score").alias("_prior_score"),
            (F.col("status") == "Compromised").alias("_prior_compromised"),
        )
        batch = batch.join(start, "node", "left")
        names = {"prior_score": "_prior_score", "prior_compromised": "_prior_compromised"}
    traced = trust_scores(
        batch, policy, order=order, tampered="tampered", rows_per_chunk=rows_per_chunk, **names
    )
    return status_transitions(traced.drop("_prior_score", "_prior_compromised"), "tampered")


TRUST_TABLES = ("trust",)


def trust_step(policy: TrustPolicy = V1, order: Sequence[str] = ("ts",), rows_per_chunk: int | None = None) -> Step:
    """Trust trace for ``stream_steps``; the state is the last row of each node. Nodes with more than
    ``rows_per_chunk`` rows in a micro-batch are cut in time and worked on by many tasks."""

    def step(records: DataFrame, before: State) -> tuple[DataFrame, State]:
        traced = settled(trust_batch(records, before.get("trust"), policy, order, rows_per_chunk))
        last = latest_state(traced, order=order, cols=[*order, "score", "status"])
        if before:
            unheard = before["trust"].join(last.select("node"), "node", "left_anti")
            last = last.unionByName(unheard)
        return traced, {"trust": last}

    return step


def stream_trust(
    records: DataFrame,
    root: str,
    checkpoint: str,
    policy: TrustPolicy = V1,
    order: Sequence[str] = ("ts",),
    trigger: dict | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    rows_per_chunk: int | None = None,
) -> StreamingQuery:
    """Run trust over a stream of scored records.

    ``records`` needs node, is_anomaly, tampered, cpu, raw_status, last_seen and the order
    columns. Writes ``root/trace/batch=N`` (all rows with status and action) and the versioned
    snapshot ``root/state``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = prepare(batch) if prepare else batch
        prior = state_before(spark, f"{root}/state", batch_id)
        target = f"{root}/trace/batch={batch_id}"
        # Several actions work on the batch; without this each would check and score it again.
        with kept(rows) as once:
            traced = trust_batch(once, prior, policy, order, rows_per_chunk)
            traced.write.mode("overwrite").parquet(target)
        # read back what was saved instead of computing the trace a second time
        saved = spark.read.schema(traced.schema).parquet(target)
        state = latest_state(
            saved, order=order, cols=["last_seen", "cpu", "score", "status", "raw_status"]
        )
        publish_state(state, batch_id, f"{root}/state")

    return (
        records.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_detect_v1(
    lines: DataFrame,
    secret: str,
    scorer: Scorer,
    root: str,
    checkpoint: str,
    threshold: float = LIVE_THRESHOLD,
    order: Sequence[str] = ("timestamp",),
    trigger: dict | None = None,
    policy: TrustPolicy = V1,
    **kw,
) -> StreamingQuery:
    """Signed metric lines as a stream -> trace and current state under ``root``.

    Checks and scores are row-local and run in the stream; trust runs per micro-batch.
    """
    scored = verify_and_score(lines, secret, scorer, threshold, **kw)
    records = scored.withColumn("last_seen", F.col("timestamp"))
    return stream_trust(records, root, checkpoint, policy, order, trigger)
