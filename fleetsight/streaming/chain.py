"""Second-generation detection as one streaming query of chained keyed operators.

Samples -> rates of counters (per node and metric) -> scaling -> the last points of every metric side by
side at each tick (per node) -> reconstruction loss and verdict -> trust score and cordon flag (per node).

Each operator keeps little: the last sample of a series, the last ``length`` points of each metric of a
node, a score and a flag. A tick is evaluated once the node is heard of in a later one, from all samples
before its end; so where micro-batches are cut changes nothing, as long as each node's samples arrive in
time order. A sample that arrives behind its tick counts from the next one on.

Defined cases: samples without node, metric, time or value are left out; samples of one time count in
the order of their values and have no rate between them; a node with fewer than ``length`` points of
any metric has no verdict at that tick; the last tick a node was heard of stays open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.jobs.detect import scaled_samples
from fleetsight.operators.predicates import classify, exclude_nodes
from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.operators.timeseries import instant_rate
from fleetsight.operators.trust import CORDON_BELOW, UNCORDON_ABOVE, V2, TrustPolicy, hysteresis_rows, latest_state, trust_rows
from fleetsight.plans.kept import settled
from fleetsight.schemas import FEATURES_V2
from fleetsight.streaming.steps import State, Step

_MICROS = 1_000_000
COUNTERS = ("net_in", "net_out")


class _RateProcessor(StatefulProcessor):
    """Counters become rates between a series' last two samples; gauges pass."""

    def __init__(self, counters: Sequence[str], range_us: int):
        self.counters, self.range_us = frozenset(counters), range_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us LONG, value DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        node, metric = key
        pdf = pd.concat(list(rows)).sort_values(["us", "value"], kind="stable")
        us, value = pdf["us"].to_numpy(), pdf["value"].to_numpy()
        if metric in self.counters:
            if self.last.exists():
                last = self.last.get()
                us, value = np.append(last[0], us), np.append(last[1], value)
            gap = np.diff(us)
            grown = np.where(value[1:] < value[:-1], value[1:], np.diff(value))
            near = (gap > 0) & (gap <= self.range_us)
            newest = int(np.argmax(us))  # the first of equal times stays only where nothing follows it
            newest = len(us) - 1 if us[-1] == us[newest] else newest
            self.last.update((int(us[newest]), float(value[newest])))
            us, value = us[1:][near], (grown[near] / (gap[near] / _MICROS))
        if len(us):
            yield pd.DataFrame({"node": node, "metric": metric, "us": us, "value": value})

    def close(self) -> None:
        pass


class _AlignProcessor(StatefulProcessor):
    """The last points of every metric of a node, side by side at each closed tick."""

    def __init__(self, metrics: Sequence[str], length: int, step_us: int, max_age_us: int | None):
        self.metrics, self.length, self.step_us, self.max_age_us = list(metrics), length, step_us, max_age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tick = handle.getValueState("tick", "tick LONG")
        self.rings = [handle.getListState(f"ring_{m}", "us LONG, value DOUBLE") for m in self.metrics]

    def _aligned(self, rings: list[list[tuple]], end: int) -> list[float] | None:
        """All points, step by step; None where a metric has too few that are recent enough."""
        if any(len(r) < self.length for r in rings):
            return None
        if self.max_age_us is not None and any(r[0][0] < end - self.max_age_us for r in rings):
            return None
        return [ring[i][1] for i in range(self.length) for ring in rings]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        pdf = pd.concat(list(rows)).sort_values(["us", "metric", "value"], kind="stable")
        now = self.tick.get()[0] if self.tick.exists() else None
        rings = [[tuple(r) for r in ring.get()] for ring in self.rings]
        ticks, sequences = [], []
        us, metric, value = (pdf[c].to_numpy() for c in ("us", "metric", "value"))
        buckets = us // self.step_us
        if now is not None:
            buckets = np.maximum(buckets, now)  # a late sample counts in the open tick
        cuts = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(buckets))
        begin = 0
        for end in cuts.tolist():
            bucket = int(buckets[begin])
            if now is not None and bucket > now:
                closed = (now + 1) * self.step_us
                sequence = self._aligned(rings, closed)
                if sequence is not None:
                    ticks.append(closed)
                    sequences.append(sequence)
            now = bucket
            for i, m in enumerate(self.metrics):
                at = np.flatnonzero(metric[begin:end] == m)[-self.length :] + begin
                rings[i] = (rings[i] + [(int(us[j]), float(value[j])) for j in at])[-self.length :]
            begin = end
        self.tick.update((now,))
        for ring, points in zip(self.rings, rings):
            ring.put(points)
        if ticks:
            yield pd.DataFrame({"node": key[0], "tick": ticks, "flat": sequences})

    def close(self) -> None:
        pass


class _CordonProcessor(StatefulProcessor):
    """Trust score and cordon flag of a node along its verdicts."""

    def __init__(self, policy: TrustPolicy, low: float, high: float, auto_remediate: bool):
        self.policy, self.low, self.high, self.auto = policy, low, high, auto_remediate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trust", "score DOUBLE, cordoned BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        p = self.policy
        score, cordoned = self.state.get() if self.state.exists() else (p.init, False)
        pdf = pd.concat(list(rows)).sort_values("tick", kind="stable")
        scores, flags, actions = [], [], []
        for status in pdf["status"]:  # one per tick
            score = min(p.hi, max(p.lo, score + (-p.decay if status == "Anomaly" else p.recovery)))
            before = cordoned
            if score < self.low:
                cordoned = True
            elif self.auto and score > self.high:
                cordoned = False
            scores.append(score)
            flags.append(cordoned)
            actions.append("CORDON" if cordoned and not before else "UNCORDON" if before and not cordoned else None)
        self.state.update((float(score), bool(cordoned)))
        yield pdf.assign(score=scores, cordoned=flags, action=pd.Series(actions, dtype=object, index=pdf.index))

    def close(self) -> None:
        pass


def stream_rates(samples: DataFrame, range_s: float, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Samples (node, metric, ts, value) -> (node, metric, us, value), counters as instant rates."""
    known = samples.dropna(subset=["node", "metric", "ts", "value"])
    points = known.select("node", "metric", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    return points.groupBy("node", "metric").transformWithStateInPandas(
        statefulProcessor=_RateProcessor(counters, int(range_s * _MICROS)),
        outputStructType="node STRING, metric STRING, us LONG, value DOUBLE",
        outputMode="append",
        timeMode="none",
    )


def stream_aligned(
    points: DataFrame,
    metrics: Sequence[str] = FEATURES_V2,
    length: int = 10,
    step_s: int = 10,
    max_age_s: float | None = None,
) -> DataFrame:
    """Points (node, metric, us, value) -> (node, tick, flat) at the end of each tick of ``step_s``: the last
    ``length`` points of all metrics, step by step. Ticks at which a metric has fewer, or its oldest one
    lies more than ``max_age_s`` back, are left out."""
    age = None if max_age_s is None else int(max_age_s * _MICROS)
    return points.groupBy("node").transformWithStateInPandas(
        statefulProcessor=_AlignProcessor(metrics, length, step_s * _MICROS, age),
        outputStructType="node STRING, tick LONG, flat ARRAY<DOUBLE>",
        outputMode="append",
        timeMode="none",
    )


def stream_cordon(
    verdicts: DataFrame,
    policy: TrustPolicy = V2,
    low: float = CORDON_BELOW,
    high: float = UNCORDON_ABOVE,
    auto_remediate: bool = True,
) -> DataFrame:
    """Verdicts (node, tick, loss, status) plus score, cordoned and action."""
    return verdicts.select("node", "tick", "loss", "status").groupBy("node").transformWithStateInPandas(
        statefulProcessor=_CordonProcessor(policy, low, high, auto_remediate),
        outputStructType="node STRING, tick LONG, loss DOUBLE, status STRING, score DOUBLE, cordoned BOOLEAN, action STRING",
        outputMode="append",
        timeMode="none",
    )


def stream_detect_v2(
    samples: DataFrame,
    scaler: DataFrame,
    model: Reconstruction,
    threshold: float,
    range_s: float = 60.0,
    step_s: int = 10,
    length: int = 10,
    metrics: Sequence[str] = FEATURES_V2,
    counters: Sequence[str] = COUNTERS,
    **cordon,
) -> DataFrame:
    """The whole chain over a stream of samples (node, metric, ts, value). ``scaler``: one row of
    ``<metric>_min`` and ``<metric>_max``."""
    wanted = exclude_nodes(samples, node="node").where(F.col("metric").isin(*metrics))
    rates = stream_rates(wanted, range_s, counters)
    aligned = stream_aligned(scaled_samples(rates, scaler, metrics), metrics, length, step_s)
    losses = aligned.select("node", "tick", model.loss_column(F.col("flat")).alias("loss"))
    return stream_cordon(classify(losses, "loss", threshold, "high"), **cordon)


# The same chain for ``stream_steps``: each operator's state is a table, its work one batch plan.

RATE_TABLES = ("last",)
ALIGN_TABLES = ("rings", "open")
TRUST_TABLES = ("trust",)


def _rates(points: DataFrame, before: State, range_s: float, counters: Sequence[str]) -> tuple[DataFrame, State]:
    """Points (node, metric, us, value), counters as rates to the sample before, and the last sample of each
    counter. A sample behind the last one does not take its place."""
    key = ["node", "metric"]
    of_counters = points.where(F.col("metric").isin(*counters)).withColumn("new", F.lit(True))
    if before:
        of_counters = of_counters.unionByName(before["last"].withColumn("new", F.lit(False)))
    timed = of_counters.withColumn("ts", F.timestamp_micros("us"))
    rates = instant_rate(timed, range_s, key).where("new AND rate IS NOT NULL").select(*key, "us", F.col("rate").alias("value"))
    gauges = points.where(~F.col("metric").isin(*counters))
    return gauges.unionByName(rates), {"last": latest_state(of_counters.drop("new"), key, ("us", "value"))}


def _aligned(
    points: DataFrame, before: State, metrics: Sequence[str], length: int, step_us: int, max_age_us: int | None
) -> tuple[DataFrame, State]:
    """(node, tick, flat) of the ticks closed by these points. State: the last points of each series and
    each node's open tick. Samples of one tick are cut to the last ``length`` before they are gathered."""
    points = points.select("node", "metric", "us", "value", F.floor(F.col("us") / step_us).cast("long").alias("bucket"))
    if before:
        # a late sample counts in the open tick
        points = points.join(before["open"], "node", "left").withColumn("bucket", F.greatest("bucket", "now")).drop("now")
        points = points.unionByName(before["rings"])
    series = Window.partitionBy("node", "metric")
    place = F.row_number().over(Window.partitionBy("node", "metric", "bucket").orderBy(F.desc("us"), F.desc("value")))
    last = points.withColumn("_place", place).where(F.col("_place") <= length)
    cells = last.groupBy("node", "metric", "bucket").agg(F.collect_list(F.struct("us", "value")).alias("cell"))
    # every cell has a point, and those of later cells are later, so ``length`` cells are enough
    near = F.collect_list("cell").over(series.orderBy("bucket").rowsBetween(1 - length, 0))
    ring = F.sort_array(F.flatten(near), asc=False)
    cells = cells.select("node", "metric", "bucket", F.reverse(F.slice(ring, 1, length)).alias("ring"))
    by_metric = [F.max(F.when(F.col("metric") == m, F.struct("ring")))["ring"].alias(m) for m in metrics]
    ticks = cells.groupBy("node", "bucket").agg(*by_metric)
    along = Window.partitionBy("node").orderBy("bucket")
    so_far = [F.last(m, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(m) for m in metrics]
    ticks = settled(ticks.select("node", "bucket", *so_far, F.lead("bucket").over(along).isNull().alias("open")))
    end = (F.col("bucket") + 1) * step_us
    full = F.lit(True)
    for m in metrics:
        full = full & (F.coalesce(F.size(m), F.lit(0)) == length)
        if max_age_us is not None:
            full = full & (F.get(m, F.lit(0))["us"] >= end - max_age_us)
    flat = F.array(*[F.get(m, F.lit(i))["value"] for i in range(length) for m in metrics])
    closed = ticks.where(~F.col("open")).where(full).select("node", end.alias("tick"), flat.alias("flat"))
    now = ticks.where("open")
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("ring")) for m in metrics])
    rings = now.select("node", "bucket", F.inline(named)).select("node", "metric", "bucket", F.explode("ring").alias("p"))
    rings = rings.select("node", "metric", "p.us", "p.value", "bucket")
    return closed, {"rings": rings, "open": now.select("node", F.col("bucket").alias("now"))}


def _cordoned(
    verdicts: DataFrame, before: State, policy: TrustPolicy = V2, low: float = CORDON_BELOW, high: float = UNCORDON_ABOVE,
    auto_remediate: bool = True,
) -> tuple[DataFrame, State]:
    """Trust and cordon flag of each node along its ticks, going on from its last ones."""
    rows = verdicts.select("node", "tick", "loss", "status", (F.col("status") == "Anomaly").alias("is_anomaly"))
    rows = rows.withColumns({"_score": F.lit(None).cast("double"), "_flag": F.lit(None).cast("boolean")})
    if before:
        prior = before["trust"].select("node", F.col("score").alias("_score"), F.col("cordoned").alias("_flag"))
        rows = rows.drop("_score", "_flag").join(prior, "node", "left")
    traced = trust_rows(rows, policy, order=("tick",), prior_score="_score")
    out = hysteresis_rows(traced, low, high, auto_remediate, prior="_flag").result()
    out = settled(out.select("node", "tick", "loss", "status", "score", "cordoned", "action"))
    state = out.select("node", "tick", "score", "cordoned")
    if before:
        state = state.unionByName(before["trust"])
    return out, {"trust": latest_state(state, order=("tick",))}


def _points(samples: DataFrame) -> DataFrame:
    known = samples.dropna(subset=["node", "metric", "ts", "value"])
    return known.select("node", "metric", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))


def rate_step(range_s: float, counters: Sequence[str] = COUNTERS) -> Step:
    """As ``stream_rates``, of samples (node, metric, ts, value)."""
    return lambda samples, before: _rates(_points(samples), before, range_s, counters)


def align_step(
    range_s: float,
    metrics: Sequence[str] = FEATURES_V2,
    length: int = 10,
    step_s: int = 10,
    max_age_s: float | None = None,
    counters: Sequence[str] = COUNTERS,
) -> Step:
    """As ``stream_aligned`` over ``stream_rates``. Late samples take their place by time among the last ones."""
    age = None if max_age_s is None else int(max_age_s * _MICROS)

    def step(samples: DataFrame, before: State) -> tuple[DataFrame, State]:
        rates, last = _rates(_points(samples.where(F.col("metric").isin(*metrics))), before, range_s, counters)
        aligned, rings = _aligned(rates, before, metrics, length, step_s * _MICROS, age)
        return aligned, last | rings

    return step


def detect_v2_step(
    scaler: DataFrame,
    model: Reconstruction,
    threshold: float,
    range_s: float = 60.0,
    step_s: int = 10,
    length: int = 10,
    metrics: Sequence[str] = FEATURES_V2,
    counters: Sequence[str] = COUNTERS,
    **cordon,
) -> Step:
    """As ``stream_detect_v2``."""

    def step(samples: DataFrame, before: State) -> tuple[DataFrame, State]:
        wanted = exclude_nodes(samples, node="node").where(F.col("metric").isin(*metrics))
        rates, last = _rates(_points(wanted), before, range_s, counters)
        scaled = scaled_samples(rates, scaler, metrics)
        aligned, rings = _aligned(scaled, before, metrics, length, step_s * _MICROS, None)
        losses = aligned.select("node", "tick", model.loss_column(F.col("flat")).alias("loss"))
        out, trust = _cordoned(classify(losses, "loss", threshold, "high"), before, **cordon)
        return out, last | rings | trust

    return step
