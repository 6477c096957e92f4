"""Keyed stateful processors: trust, zero-fill and sequence scoring.

State lives in the RocksDB state store under the query checkpoint, so it survives lost executors.
Rows of one key in one micro-batch arrive in bounded Arrow chunks; admission limits on the source
(``maxFilesPerTrigger`` and the like) bound the batch itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.operators.trust import V1, TrustPolicy, status_transitions
from fleetsight.plans.grids import BLOCK, explode_steps
from fleetsight.plans.kept import settled
from fleetsight.plans.ordered import compose_prefixes
from fleetsight.schemas import EVENT_COUNTS
from fleetsight.streaming.steps import State, Step, watermarks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


class _TrustProcessor(StatefulProcessor):
    """Score and latch per node; one state row per node."""

    def __init__(self, policy: TrustPolicy, order: Sequence[str]):
        self.policy = policy
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trust", "score DOUBLE, compromised BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        p = self.policy
        score, seen = (self.state.get() if self.state.exists() else (p.init, False))
        # arrival chunks may interleave in time, so the batch of one node is ordered as a whole
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        bad = pdf["tampered"].fillna(False).to_numpy(dtype=bool)
        anomaly = pdf["is_anomaly"].fillna(False).to_numpy(dtype=bool)
        delta = np.where(bad, 0.0, np.where(anomaly, -p.decay, p.recovery))
        lo = np.where(bad, 0.0, p.lo)
        hi = np.where(bad, 0.0, p.hi)
        first = min(hi[0], max(lo[0], score + delta[0]))
        lo[0] = hi[0] = first
        _, after, _ = compose_prefixes(delta, lo, hi)
        latched = np.logical_or.accumulate(bad) | seen
        out = pdf.copy()
        out["prev_score"] = np.concatenate([[score], after[:-1]])
        out["score"] = after
        out["prev_compromised"] = np.concatenate([[seen], latched[:-1]]).astype(float)
        out["compromised"] = latched.astype(float)
        self.state.update((float(after[-1]), bool(latched[-1])))
        yield out

    def close(self) -> None:
        pass


def stream_trust_keyed(
    records: DataFrame,
    policy: TrustPolicy = V1,
    key: str = "node",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Scored stream (node, is_anomaly, tampered, order columns) -> trust trace with status and
    action. Order is event order inside a micro-batch and arrival order between them.

    One task handles a node's rows of a micro-batch, so this form suits streams whose batches
    are kept small by admission limits; ``streaming.trust`` splits busy nodes instead."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    schema += (
        ", prev_score DOUBLE, score DOUBLE, prev_compromised DOUBLE, compromised DOUBLE"
    )
    traced = records.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_TrustProcessor(policy, order),
        outputStructType=schema,
        outputMode="append",
        timeMode="none",
    )
    return status_transitions(traced, "tampered")


class _DensifyProcessor(StatefulProcessor):
    """Passes feature rows on and emits zero rows for windows in which a node was silent.

    State per node: start of the last window emitted. An event-time timer at the end of the next
    window fires when the watermark shows that the node said nothing in it.
    """

    def __init__(self, window_ms: int, counts: Sequence[str]):
        self.window_ms = window_ms
        self.counts = list(counts)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start_ms LONG")

    def _blocks(self, first: int, end: int) -> Iterator[tuple[int, int]]:
        """Stretches of bounded length: one stray time, years away, makes no frame of unbounded size."""
        step = self.window_ms * BLOCK
        for a in range(first, end, step):
            yield a, min(a + step, end)

    def _zero_rows(self, node: str, first: int, end: int) -> pd.DataFrame:
        starts = np.arange(first, end, self.window_ms)
        out = pd.DataFrame({"node": node, "window_start": pd.to_datetime(starts, unit="ms")})
        for c in self.counts:
            out[c] = 0
        out["late"] = False
        return out

    def _rearm(self, start_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        # the window after the last one is complete two widths after the last start
        self.handle.registerTimer(start_ms + 2 * self.window_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        starts = pdf["window_start"].astype("datetime64[ms]").astype("int64").to_numpy()
        first = int(starts.min())
        last = self.last.get()[0] if self.last.exists() else first - self.window_ms
        fresh = starts > last  # a window already filled with zeros is closed
        if not fresh.all():
            late = pdf[~fresh][["node", "window_start", *self.counts]].copy()
            late["late"] = True
            yield late
        if fresh.any():
            end = int(starts.max())
            known, given = starts[fresh], pdf[self.counts].to_numpy()[fresh]
            for a, b in self._blocks(last + self.window_ms, end + self.window_ms):
                out = self._zero_rows(key[0], a, b)
                inside = (known >= a) & (known < b)
                place = (known[inside] - a) // self.window_ms
                for i, c in enumerate(self.counts):
                    values = out[c].to_numpy(copy=True)
                    values[place] = given[inside, i]
                    out[c] = values
                yield out
            last = end
            self.last.update((last,))
        self._rearm(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0]
        done = last + max(0, (now - last) // self.window_ms - 1) * self.window_ms
        if done > last:
            for a, b in self._blocks(last + self.window_ms, done + self.window_ms):
                yield self._zero_rows(key[0], a, b)
            self.last.update((done,))
        self._rearm(done)

    def close(self) -> None:
        pass


def stream_densify(
    features: DataFrame, window_seconds: int, counts: Sequence[str] = EVENT_COUNTS
) -> DataFrame:
    """Zero rows for silent nodes. ``features`` needs a watermark on ``window_start`` and one row
    per node and window (closed windows of ``stream_event_features``).

    A row whose window already went out as zeros comes out with ``late`` set: it corrects that zero
    row, and nothing is lost. All other rows have ``late`` false.
    """
    counted = ", ".join(f"{c} BIGINT" for c in counts)
    schema = f"node STRING, window_start TIMESTAMP, {counted}, late BOOLEAN"
    return (
        features.select("node", "window_start", *counts)
        .groupBy("node")
        .transformWithStateInPandas(
            statefulProcessor=_DensifyProcessor(window_seconds * 1000, counts),
            outputStructType=schema,
            outputMode="append",
            timeMode="eventTime",
        )
    )


DENSE_TABLES = ("last", "clock")


def dense_step(window_seconds: int, counts: Sequence[str] = EVENT_COUNTS) -> Step:
    """As ``stream_densify``, for ``stream_steps``. What closed windows tell of the watermark counts: a node's
    zero rows go up to the end of the latest window that any node closed."""
    width = window_seconds * 1_000_000

    def step(features: DataFrame, before: State) -> tuple[DataFrame, State]:
        rows = features.select("node", F.unix_micros("window_start").alias("us"), *counts)
        _, mark, clock = watermarks(rows.select((F.col("us") + width).alias("us")), before, "0 seconds")
        rows = rows.withColumn("last", F.lit(None).cast("long"))
        last = rows.select("node", "us").where("false")
        if before:
            last = before["last"]
            rows = rows.drop("last").join(last.select("node", F.col("us").alias("last")), "node", "left")
        known = F.col("last").isNotNull() & (F.col("us") <= F.col("last"))
        late, fresh = rows.where(known), rows.where(~known)
        # the first window of each node that is not out yet, and the last one that is closed
        begins = last.select("node", (F.col("us") + width).alias("begin"), F.lit(0).alias("_n"))
        begins = begins.unionByName(fresh.select("node", F.col("us").alias("begin"), F.lit(1).alias("_n")))
        nodes = begins.groupBy("node").agg(F.min_by("begin", F.struct("_n", "begin")).alias("begin"))
        count = F.greatest(F.floor((F.lit(mark * 1000) - F.col("begin")) / width), F.lit(0)).cast("long")
        nodes = settled(nodes.withColumn("end", F.col("begin") + (count - 1) * width))
        grid = nodes.select("node", F.timestamp_micros("begin").alias("begin"), F.timestamp_micros("end").alias("end"))
        grid = explode_steps(grid, "begin", "end", F.lit(width), "window_start")
        zeros = grid.select("node", F.unix_micros("window_start").alias("us"), *[F.lit(0).cast("long").alias(c) for c in counts])
        dense = fresh.select("node", "us", *counts).unionByName(zeros).groupBy("node", "us").agg(*[F.sum(c).alias(c) for c in counts])
        start = F.timestamp_micros("us").alias("window_start")
        both = dense.select("node", start, *counts, F.lit(False).alias("late"))
        both = both.unionByName(late.select("node", start, *counts, F.lit(True).alias("late")))
        return both, {"last": nodes.select("node", F.col("end").alias("us")), "clock": clock}

    return step


class _SequenceProcessor(StatefulProcessor):
    """Ring of the last n feature rows per node; one score per new row once the ring is full."""

    def __init__(self, model: Reconstruction, n: int, feats: Sequence[str]):
        self.model = model
        self.n = n
        self.feats = list(feats)

    def init(self, handle: StatefulProcessorHandle) -> None:
        cols = ", ".join(f"f{i} DOUBLE" for i in range(len(self.feats)))
        self.ring = handle.getListState("ring", cols)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("ts")
        new = pdf[self.feats].to_numpy(dtype=float)
        old = np.array([tuple(r) for r in self.ring.get()], dtype=float).reshape(-1, new.shape[1])
        points = np.concatenate([old, new])
        if len(points) >= self.n:
            views = np.lib.stride_tricks.sliding_window_view(points, self.n, axis=0)
            # sequences that end on a new row
            seqs = views[max(0, len(old) - self.n + 1) :].transpose(0, 2, 1)
            flat = seqs.reshape(len(seqs), -1)
            yield pd.DataFrame(
                {
                    "node": key[0],
                    "ts": pdf["ts"].to_numpy()[len(new) - len(flat) :],
                    "loss": self.model.loss(flat),
                }
            )
        kept = points[-(self.n - 1) :] if self.n > 1 else points[:0]
        self.ring.put([tuple(float(v) for v in r) for r in kept])

    def close(self) -> None:
        pass


def stream_sequence_scores(
    points: DataFrame, model: Reconstruction, feats: Sequence[str], n: int = 10
) -> DataFrame:
    """Scaled metric rows (node, ts, features) -> reconstruction error of the last n rows."""
    return (
        points.select("node", "ts", *[F.col(f).cast("double").alias(f) for f in feats])
        .dropna(subset=list(feats))
        .groupBy("node")
        .transformWithStateInPandas(
            statefulProcessor=_SequenceProcessor(model, n, feats),
            outputStructType="node STRING, ts TIMESTAMP, loss DOUBLE",
            outputMode="append",
            timeMode="none",
        )
    )
