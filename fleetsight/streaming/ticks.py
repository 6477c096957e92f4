"""Counter rates and as-of values on a grid of ticks, while samples arrive.

Each series (node, metric) keeps the samples of the trailing range, in state cells of one tick each, and a
timer at its next tick. Once the watermark passes a tick, it is evaluated over all samples up to it, so it
does not matter how input is cut into micro-batches, or in which order samples come, as long as they are
not later than the watermark's delay. A sample that comes after its tick was evaluated counts from the next
one on, and is counted in ``late`` there: samples in = samples evaluated in time + ``late``.

A silent series costs one state value and no row: a tick has a row where a sample lies in its range (or late
ones are to be counted). One task holds a series' samples of the range and of the ticks not evaluated yet.

Defined cases: samples without node, metric, time or value are left out; samples of one time count in the
order of their values; with fewer than two times in range the rate is null, as it is for gauges; a latest
sample older than the lookback is null; ticks the watermark has not passed when the input ends stay open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.plans.grids import BLOCK
from fleetsight.plans.kept import settled
from fleetsight.streaming.chain import COUNTERS
from fleetsight.streaming.steps import State, Step, watermarks

_MICROS = 1_000_000


def evaluate(
    ticks: np.ndarray, us: np.ndarray, value: np.ndarray, range_us: int, lookback_us: int, counter: bool
) -> pd.DataFrame:
    """(tick, sample_us, value, rate, seen) of ascending ``ticks`` over samples in order of (time, value)."""
    grown = np.zeros(len(us))
    if len(us) > 1:
        steps = np.where(value[1:] < value[:-1], value[1:], np.diff(value))  # a reset counts from zero
        grown[1:] = np.cumsum(steps)
    past = np.searchsorted(us, ticks, "right")
    first = np.searchsorted(us, ticks - range_us, "left")
    recent = np.searchsorted(us, ticks - lookback_us, "left")
    known = past > recent
    last = np.maximum(past - 1, 0)
    out = pd.DataFrame({"tick": ticks})
    if len(us) == 0:
        return out.assign(sample_us=pd.array([pd.NA] * len(out), "Int64"), value=np.nan, rate=np.nan, seen=False)
    out["sample_us"] = pd.array(us[last], "Int64")
    out.loc[~known, "sample_us"] = pd.NA
    out["value"] = np.where(known, value[last], np.nan)
    start = np.minimum(first, len(us) - 1)
    span = us[last] - us[start]
    sloped = counter & (past > first) & (span > 0)
    out["rate"] = np.where(sloped, (grown[last] - grown[start]) / (np.where(sloped, span, 1) / _MICROS), np.nan)
    out["seen"] = past > np.minimum(first, recent)
    return out


class _TickProcessor(StatefulProcessor):
    def __init__(self, counters: Sequence[str], step_us: int, range_us: int, lookback_us: int):
        self.counters, self.step_us = frozenset(counters), step_us
        self.range_us, self.lookback_us = range_us, lookback_us
        self.keep_us = max(range_us, lookback_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next LONG, late LONG")
        # the samples whose first tick is this one
        self.cells = handle.getMapState("cells", "tick LONG", "us ARRAY<LONG>, value ARRAY<DOUBLE>")

    def _wake(self, tick: int) -> None:
        """The one timer of the series stands at the first tick that has something to tell."""
        due = tick * self.step_us // 1000
        for timer in list(self.handle.listTimers()):
            if timer == due:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        tick, late, lowest = None, 0, None
        if self.at.exists():
            tick, late = self.at.get()
        for pdf in rows:  # bounded chunks
            firsts = -(-pdf["us"].to_numpy() // self.step_us)
            if tick is not None:
                late += int((firsts < tick).sum())
            lowest = int(firsts.min()) if lowest is None else min(lowest, int(firsts.min()))
            for cell, part in pdf.groupby(firsts):
                us, value = self.cells.getValue((int(cell),)) if self.cells.containsKey((int(cell),)) else ([], [])
                self.cells.updateValue((int(cell),), ([*us, *part["us"].tolist()], [*value, *part["value"].tolist()]))
        if lowest is not None:
            tick = lowest if tick is None else tick
            self.at.update((tick, late))
            ahead = min(int(cell[0]) for cell in self.cells.keys())
            self._wake(tick if late else max(tick, ahead))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        tick, late = self.at.get()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.step_us
        span = self.keep_us // self.step_us
        held = sorted((int(cell[0]), *cells) for cell, cells in self.cells.iterator())
        cells = np.array([c for c, _, _ in held], dtype=np.int64)
        us = np.array([x for _, times, _ in held for x in times], dtype=np.int64)
        value = np.array([x for _, _, values in held for x in values], dtype=float)
        order = np.lexsort((value, us))
        us, value = us[order], value[order]
        # ticks that may see a sample: at most span + 1 behind each cell, whatever the silence between
        ticks = np.unique((cells[:, None] + np.arange(span + 2)).ravel())
        ticks = ticks[(ticks >= tick) & (ticks <= passed)]
        if late and tick <= passed and tick not in ticks:
            ticks = np.append(tick, ticks)
        for a in range(0, len(ticks), BLOCK):
            found = evaluate(
                ticks[a : a + BLOCK] * self.step_us, us, value, self.range_us, self.lookback_us, key[1] in self.counters
            )
            found["late"] = 0
            if a == 0:
                found.loc[0, "late"] = late
            found = found[found["seen"] | (found["late"] > 0)].drop(columns="seen")
            if len(found):
                found.insert(0, "node", key[0])
                found.insert(1, "metric", key[1])
                yield found
        tick = max(tick, passed + 1)
        for cell in cells[cells * self.step_us < tick * self.step_us - self.keep_us].tolist():
            self.cells.removeKey((cell,))
        left = cells[cells * self.step_us >= tick * self.step_us - self.keep_us]
        self.at.update((tick, 0))
        if len(left):
            self._wake(max(tick, int(left.min())))

    def close(self) -> None:
        pass


TICK_TABLES = ("cells", "series", "clock")


def tick_step(
    step_s: int,
    range_s: float,
    lookback_s: float | None = None,
    counters: Sequence[str] = COUNTERS,
    delay: str = "10 seconds",
    ts: str = "ts",
) -> Step:
    """As ``stream_at_ticks``, for ``stream_steps``: the samples of the range and the next tick of each
    series are state tables. A series' rows are laid out and ordered once; each sample is written to the
    ticks whose range holds it, about range / step, and these are combined where they are."""
    if step_s <= 0 or range_s <= 0:
        raise ValueError("step and range must be positive")
    step_us, range_us = int(step_s) * _MICROS, int(range_s * _MICROS)
    lookback_us = int((range_s if lookback_s is None else lookback_s) * _MICROS)
    keep_us = max(range_us, lookback_us)
    key = ["node", "metric"]

    def step(samples: DataFrame, before: State) -> tuple[DataFrame, State]:
        known = samples.dropna(subset=["node", "metric", ts, "value"])
        points = known.select(*key, F.unix_micros(ts).alias("us"), F.col("value").cast("double").alias("value"))
        _, mark, clock = watermarks(points.select("us"), before, delay)
        passed = mark * 1000 // step_us
        up = F.col("us") + F.pmod(-F.col("us"), F.lit(step_us))
        rows = points.withColumns({"cell": F.floor(up / step_us).cast("long"), "new": F.lit(True)})
        if before:
            rows = rows.unionByName(before["cells"].withColumn("new", F.lit(False)))
            rows = rows.unionByName(before["series"], allowMissingColumns=True)
        else:
            rows = rows.withColumns({"next": F.lit(None).cast("long"), "late": F.lit(0).cast("long")})
        whole, ordered = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("us", "value")
        fresh = F.coalesce("new", F.lit(False))
        rows = rows.withColumn("_next", F.max("next").over(whole))
        behind = F.when(fresh & (F.col("cell") < F.col("_next")), 1).otherwise(0) + F.coalesce("late", F.lit(0))
        grown = F.col("value") - F.col("_before")
        grown = F.when(F.col("_before").isNull(), 0.0).when(grown < 0, F.col("value")).otherwise(grown)  # a reset counts from zero
        rows = rows.withColumns(
            {
                "_late": F.sum(behind).over(whole),
                "_next": F.coalesce("_next", F.min(F.when(fresh, F.col("cell"))).over(whole)),
                "_least": F.min("cell").over(whole),
                "_before": F.lag("value").over(ordered),
            }
        ).withColumn("_grown", F.sum(grown).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        due = F.when(F.col("_late") > 0, F.col("_next")).otherwise(F.greatest("_next", "_least"))
        rows = rows.withColumn("_fires", F.coalesce(due <= passed, F.lit(False)))
        rows = settled(rows.select(*key, "us", "value", "cell", "_next", "_late", "_grown", "_fires"))

        is_sample = F.col("us").isNotNull()
        first = F.greatest("cell", "_next")
        last = F.least(F.floor((F.col("us") + keep_us) / step_us), F.lit(passed))
        sampled = rows.where(is_sample & F.col("_fires")).where(first <= last)
        sampled = sampled.withColumns({"_first": first, "_steps": last - first})
        blocks = sampled.withColumn("_block", F.explode(F.expr(f"sequence(0L, _steps, {BLOCK}L)")))
        steps = blocks.withColumn("_i", F.explode(F.expr(f"sequence(_block, least(_block + {BLOCK - 1}, _steps))")))
        tick = ((F.col("_first") + F.col("_i")) * step_us).alias("tick")
        seen = steps.select(*key, tick, "us", "value", "_grown", F.lit(0).cast("long").alias("late"))
        told = rows.where(F.col("_fires") & (F.col("_late") > 0)).groupBy(*key, (F.col("_next") * step_us).alias("tick"))
        told = told.agg(F.max("_late").alias("late"))
        point = F.struct("us", "_grown")
        ticks = seen.unionByName(told, allowMissingColumns=True).groupBy(*key, "tick").agg(
            F.min(F.when(F.col("us") >= F.col("tick") - range_us, point)).alias("_a"),
            F.max(F.when(F.col("us").isNotNull(), F.struct("us", "value", "_grown"))).alias("_b"),
            F.max("late").alias("late"),
        )
        known_value = F.col("_b.us") >= F.col("tick") - lookback_us
        span = F.col("_b.us") - F.col("_a.us")
        rate = F.when(F.col("metric").isin(*counters) & (span > 0), (F.col("_b._grown") - F.col("_a._grown")) / (span / _MICROS))
        out = ticks.select(
            *key, "tick", F.when(known_value, F.col("_b.us")).alias("sample_us"), F.when(known_value, F.col("_b.value")).alias("value"),
            rate.alias("rate"), "late",
        )

        after = F.when(F.col("_fires"), F.greatest("_next", F.lit(passed + 1))).otherwise(F.col("_next"))
        held = rows.where(is_sample & (~F.col("_fires") | (F.col("cell") * step_us >= after * step_us - keep_us)))
        series = rows.groupBy(*key).agg(F.max(after).alias("next"), F.max(F.when(~F.col("_fires"), F.col("_late")).otherwise(0)).alias("late"))
        return out, {"cells": held.select(*key, "us", "value", "cell"), "series": series, "clock": clock}

    return step


def stream_at_ticks(
    samples: DataFrame,
    step_s: int,
    range_s: float,
    lookback_s: float | None = None,
    counters: Sequence[str] = COUNTERS,
    delay: str = "10 seconds",
    ts: str = "ts",
) -> DataFrame:
    """Samples (node, metric, ts, value) -> (node, metric, tick, sample_us, value, rate, late) at every
    multiple of ``step_s``: the latest sample within ``lookback_s`` (by default the range) and, for
    counters, the growth per second over the trailing range (both ends included)."""
    if step_s <= 0 or range_s <= 0:
        raise ValueError("step and range must be positive")
    known = samples.dropna(subset=["node", "metric", ts, "value"]).withWatermark(ts, delay)
    # Only the stream's watermark is used, not its filter: that looks at columns of event time.
    points = known.select("node", "metric", F.unix_micros(ts).alias("us"), F.col("value").cast("double").alias("value"))
    lookback = range_s if lookback_s is None else lookback_s
    return points.groupBy("node", "metric").transformWithStateInPandas(
        statefulProcessor=_TickProcessor(counters, int(step_s) * _MICROS, int(range_s * _MICROS), int(lookback * _MICROS)),
        outputStructType="node STRING, metric STRING, tick LONG, sample_us LONG, value DOUBLE, rate DOUBLE, late LONG",
        outputMode="append",
        timeMode="eventTime",
    )
