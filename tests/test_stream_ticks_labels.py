"""Tick evaluation and late-window labels of streams against their batch forms."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators.labeling import label_by_windows
from fleetsight.operators.timeseries import asof_latest, rate_at_ticks
from fleetsight.registry import streams
from fleetsight.streaming.labels import first_labels, labeled_rows, late_windows, stream_labels
from fleetsight.streaming.ticks import evaluate, stream_at_ticks

SF = "/root/testdata/sf0.001"
DAY = 86_400


def test_evaluated_ticks_equal_the_batch_operators(spark):
    """Resets, ties, gaps, single samples and both ends of the range."""
    rng = np.random.default_rng(5)
    us = np.sort(rng.integers(0, 400, 120)) * 1_000_000
    value = rng.integers(0, 50, 120).astype(float)
    order = np.lexsort((value, us))
    us, value = us[order], value[order]
    ticks = np.arange(0, 460, 10) * 1_000_000
    got = evaluate(ticks, us, value, 30_000_000, 15_000_000, True)
    samples = spark.createDataFrame(pd.DataFrame({"node": "a", "us": us, "value": value}))
    samples = samples.select("node", F.timestamp_micros("us").alias("ts"), "value")
    asked = spark.createDataFrame(pd.DataFrame({"node": "a", "us": ticks})).select("node", F.timestamp_micros("us").alias("tick"))
    rates = rate_at_ticks(samples, asked, 30, key=["node"]).select(F.unix_micros("tick"), F.round("rate", 6)).collect()
    latest = asof_latest(samples, asked, 15, key=["node"]).select(F.unix_micros("tick"), F.unix_micros("sample_ts"), "value").collect()
    none = lambda x: None if pd.isna(x) else x
    assert sorted((r.tick, none(round(r.rate, 6))) for r in got.itertuples()) == sorted(map(tuple, rates))
    assert sorted((r.tick, none(r.sample_us), none(r.value)) for r in got.itertuples()) == sorted(map(tuple, latest))


def test_evaluate_without_samples():
    none = np.array([], dtype=np.int64)
    got = evaluate(np.array([10, 20]), none, none.astype(float), 5, 5, True)
    assert not got["seen"].any() and got["rate"].isna().all() and got["value"].isna().all()


def test_late_samples_are_counted(spark):
    """Samples that arrive long after their ticks: each tick comes out once, and they are told."""
    late = F.col("event_id") % 37 == 5
    found = streams.arrivals(spark, SF, lambda ev: stream_at_ticks(streams._wrapping(ev), 21_600, DAY), late=late).collect()
    keys = [(r.node, r.metric, r.tick) for r in found]
    assert len(keys) == len(set(keys))
    moved = ad.events(spark, SF).where(late).count() * 4
    assert 0 < sum(r.late for r in found) <= moved


def test_first_labels_by_position():
    windows = [(7, 0, 100, "wide"), (3, 10, 20, "early"), (5, 15, 30, None)]
    assert first_labels(np.array([25, 12, 101, 15, 0]), windows, "normal") == ["normal", "early", "normal", "early", "wide"]
    assert first_labels(np.array([], dtype=np.int64), windows, "normal") == []
    assert first_labels(np.array([4]), [], "normal") == ["normal"]


def _rows(ev):
    moment = F.when(F.col("event_id") % 50 != 7, F.unix_timestamp("ts"))
    return ev.select("event_id", "node", "ts", F.when(F.col("k") > 50, F.col("value")).alias("value"), moment.alias("epoch"))


def test_labels_equal_the_batch_operator(spark):
    """Windows arrive days after their rows; columns of held rows come back as they were."""

    def build(ev):
        return stream_labels(_rows(ev), streams._announced(ev), "3 days", 3600, salts=3)

    found = streams.arrivals(spark, SF, build).persist()
    assert late_windows(found).count() == 0
    got = labeled_rows(found)
    ev = ad.events(spark, SF)
    end = ev.agg(F.max(F.unix_timestamp("ts"))).first()[0] - 3 * DAY
    whole = label_by_windows(_rows(ev), streams._announced(ev))
    closed = whole.where(f"epoch IS NULL OR (floor(epoch / 3600) + 1) * 3600 <= {end}")
    cols = ["event_id", "node", "ts", "value", "epoch", "label"]
    want = sorted(map(tuple, closed.select(cols).collect()))
    assert sorted(map(tuple, got.select(cols).collect())) == want
    assert len({r[-1] for r in want}) > 2 and got.where("late").count() == 0


def test_late_rows_and_windows_are_told(spark):
    """With a short delay the rows and windows that come behind closed cells are not lost unseen."""
    late = F.col("event_id") % 37 == 5

    def build(ev):
        return stream_labels(_rows(ev), ad.scenario_windows(ev), "1 hour", 3600, salts=2)

    found = streams.arrivals(spark, SF, build, late=late).persist()
    rows = labeled_rows(found)
    ids = [r[0] for r in rows.select("event_id").collect()]
    ev = ad.events(spark, SF)
    span = ev.agg(F.max(F.unix_timestamp("ts")).alias("b")).first().b
    due = ev.where(f"(floor(unix_timestamp(ts) / 3600) + 1) * 3600 <= {span - 3600}").count()
    assert len(ids) == len(set(ids)) >= due
    told = rows.where("late")
    assert told.count() > 0 and told.where("label IS NOT NULL").count() == 0
    assert late_windows(found).select("pos").distinct().where("pos % 37 <> 5").count() == 0 and late_windows(found).count() > 0
