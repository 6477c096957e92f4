"""Windowed features of a stream that loses no row unseen.

A windowed aggregation with a watermark drops rows behind it silently, and emits a window only once the
watermark has passed it. Here every micro-batch emits a revision of each window it touches, corrections
of closed windows included; a row that comes after a window's state is gone is counted in the output.
So at any time: rows in = rows of the latest revisions + rows counted as dropped.

State is kept per (node, window), so the windows of a busy node spread over tasks. It is given up when
the watermark has passed the window's end by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.functions.scalars import is_mining_port, is_tmp_exec
from fleetsight.operators.events import WINDOW
from fleetsight.plans.grids import width_micros
from fleetsight.plans.kept import settled
from fleetsight.schemas import EVENT_COUNTS
from fleetsight.streaming.steps import State, Step, watermarks

# What a row adds to the counts of its window; the distinct count comes from ``binary``.
_ADDED = [c for c in EVENT_COUNTS if c != "unique_process_count"]


class _RevisionProcessor(StatefulProcessor):
    def __init__(self, width_us: int, keep_ms: int):
        self.width_us, self.keep_ms = width_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        added = ", ".join(f"{c} LONG" for c in _ADDED)
        self.counts = handle.getValueState("counts", f"{added}, unique_process_count LONG, counted LONG, revision LONG")
        self.binaries = handle.getMapState("binaries", "binary STRING", "seen BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        node, start = key
        end_ms = (start + self.width_us) // 1000
        now = timerValues.getCurrentWatermarkInMs()
        gone = end_ms + self.keep_ms <= now
        names = [*_ADDED, "unique_process_count", "counted", "revision"]
        have = dict(zip(names, self.counts.get())) if self.counts.exists() and not gone else dict.fromkeys(names, 0)
        n = 0
        for pdf in rows:  # bounded chunks
            n += len(pdf)
            if gone:
                continue
            for c in _ADDED:
                have[c] += int(pdf[c].sum())
            for binary in pdf["binary"].dropna().unique():
                if not self.binaries.containsKey((binary,)):
                    self.binaries.updateValue((binary,), (True,))
                    have["unique_process_count"] += 1
        if gone:
            yield self._row(node, start, dict.fromkeys(names, 0), True, n)
            return
        have["counted"] += n
        have["revision"] += 1
        self.counts.update(tuple(have[c] for c in names))
        self.handle.registerTimer(end_ms + self.keep_ms)
        yield self._row(node, start, have, end_ms <= now, 0)

    def _row(self, node: str, start: int, have: dict, closed: bool, dropped: int) -> pd.DataFrame:
        cells = {c: [have[c]] for c in (*EVENT_COUNTS, "counted", "revision")}
        return pd.DataFrame({"node": [node], "start_us": [start], **cells, "closed": [closed], "dropped": [dropped]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.counts.clear()
        self.binaries.clear()
        yield from ()

    def close(self) -> None:
        pass


def _window_rows(events: DataFrame, window: str, ts: str) -> DataFrame:
    """What each event adds to its window."""
    is_exec, is_connect = F.col("event_class") == "exec", F.col("event_class") == "connect"
    added = {
        "exec_count": is_exec,
        "tmp_exec_count": is_exec & is_tmp_exec(F.col("binary")),
        "outbound_connect_count": is_connect,
        "mining_port_count": F.when(is_connect, F.size(F.filter("dports", is_mining_port))),
    }
    start = F.unix_micros(F.window(ts, window)["start"])
    return events.select(
        "node",
        start.alias("start_us"),
        F.when(is_exec, F.col("binary")).alias("binary"),
        *[F.coalesce(added[c].cast("long"), F.lit(0).cast("long")).alias(c) for c in _ADDED],
    )


REVISION_TABLES = ("windows", "binaries", "clock")


def revision_step(window: str = WINDOW, delay: str = "10 seconds", keep: str = "1 hour", ts: str = "ts") -> Step:
    """As ``stream_revisions``, for ``stream_steps``: windows and their binaries are state tables, added to
    by one aggregation of each micro-batch."""

    def step(events: DataFrame, before: State) -> tuple[DataFrame, State]:
        width, kept = events.sparkSession.range(1).select(width_micros(window), width_micros(keep)).first()
        old, new, clock = watermarks(events.select(F.unix_micros(ts).alias("us")), before, delay)
        key = ["node", "start_us"]
        end_ms = F.floor((F.col("start_us") + width) / 1000)
        rows = _window_rows(events.where(F.col(ts).isNotNull()), window, ts)
        gone = end_ms + kept // 1000 <= old
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        # once per (window, binary), so that a busy window is combined in many tasks
        live = rows.where(~gone).groupBy(*key, "binary").agg(*[F.sum(c).alias(c) for c in _ADDED], F.count(one).alias("counted"))
        live = settled(live)
        windows = live.select(*key, *_ADDED, "counted", none.alias("revision"), one.alias("touched"), none.alias("unique"))
        named = live.where("binary IS NOT NULL").select(*key, "binary")
        if before:
            windows = windows.unionByName(before["windows"].select("*", none.alias("touched"), none.alias("unique")))
            named = settled(named.union(before["binaries"]).distinct())
        zeros = [none.alias(c) for c in (*_ADDED, "counted", "revision", "touched")]
        unique = named.groupBy(*key).agg(F.count(one).alias("unique")).select(*key, *zeros, "unique")
        sums = [F.sum(c).alias(c) for c in (*_ADDED, "counted")]
        revised = windows.unionByName(unique).groupBy(*key).agg(
            *sums, F.sum("unique").alias("unique_process_count"), (F.max("revision") + F.max("touched")).alias("revision"),
            F.max("touched").alias("touched"),
        )
        revised = settled(revised)
        start = F.timestamp_micros("start_us").alias("window_start")
        cells = [*EVENT_COUNTS, "counted", "revision"]
        out = revised.where("touched = 1").select("node", *cells, (end_ms <= old).alias("closed"), none.alias("dropped"), start)
        lost = rows.where(gone).groupBy(*key).agg(F.count(one).alias("dropped"))
        lost = lost.select("node", *[none.alias(c) for c in cells], F.lit(True).alias("closed"), "dropped", start)
        held = end_ms + kept // 1000 > new
        after = {"windows": revised.where(held).select(*key, *_ADDED, "counted", "revision"), "binaries": named.where(held), "clock": clock}
        return out.unionByName(lost), after

    return step


def stream_revisions(
    events: DataFrame, window: str = WINDOW, delay: str = "10 seconds", keep: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """Parsed events -> (node, window_start, counts, counted, revision, closed, dropped). ``counted``: rows
    in the counts. A row with ``dropped`` > 0 has no counts, but tells how many rows came too late."""
    spark = events.sparkSession
    width, kept = spark.range(1).select(width_micros(window), width_micros(keep)).first()
    # Only the stream's watermark is used, not its filter: that looks at columns of event time.
    rows = _window_rows(events.withWatermark(ts, delay), window, ts)
    counts = ", ".join(f"{c} LONG" for c in (*EVENT_COUNTS, "counted", "revision"))
    revised = rows.groupBy("node", "start_us").transformWithStateInPandas(
        statefulProcessor=_RevisionProcessor(width, kept // 1000),
        outputStructType=f"node STRING, start_us LONG, {counts}, closed BOOLEAN, dropped LONG",
        outputMode="append",
        timeMode="eventTime",
    )
    return revised.withColumn("window_start", F.timestamp_micros("start_us")).drop("start_us")


def latest_revisions(revisions: DataFrame, extra: Sequence[str] = ("counted", "revision", "closed")) -> DataFrame:
    """The latest revision of every window."""
    kept = [*EVENT_COUNTS, *extra]
    newest = F.max_by(F.struct(*kept), "revision").alias("_r")
    return revisions.where("revision > 0").groupBy("node", "window_start").agg(newest).select("node", "window_start", "_r.*")


def dropped_rows(revisions: DataFrame) -> DataFrame:
    """(node, window_start, dropped): how many rows came after their window's state was gone."""
    return revisions.where("dropped > 0").groupBy("node", "window_start").agg(F.sum("dropped").alias("dropped"))
