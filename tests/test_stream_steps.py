"""Streams worked on by batch operators over state tables give what the keyed processors give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.operators.trust import status_transitions, trust_scores
from fleetsight.registry import streams
from fleetsight.sources.lines import parse_kernel_events
from fleetsight.streaming.chain import ALIGN_TABLES, RATE_TABLES, TRUST_TABLES, detect_v2_step, stream_detect_v2
from fleetsight.streaming.labels import LABEL_TABLES, label_input, label_step, labeled_rows, late_windows, stream_labels
from fleetsight.streaming.late import REVISION_TABLES, revision_step, stream_revisions
from fleetsight.streaming.stateful import dense_step
from fleetsight.streaming.ticks import TICK_TABLES, stream_at_ticks, tick_step
from fleetsight.streaming.trust import trust_step

SF = "/root/testdata/sf0.001"
DAY = 86_400
LATE = "event_id % 37 = 5"


def _same(a, b, cols):
    rows = [sorted(map(tuple, df.select(*cols).collect()), key=str) for df in (a, b)]
    assert rows[0] and rows[0] == rows[1]


def test_revisions_by_steps(spark):
    """Every revision, with corrections of closed windows and counts of lost rows."""

    def parsed(ev):
        return parse_kernel_events(ad.kernel_lines(ev))

    keyed = streams.arrivals(spark, SF, lambda ev: stream_revisions(parsed(ev), "1 day", keep="5 days"), late=F.expr(LATE))
    steps = streams.arrivals_in_steps(spark, SF, parsed, revision_step("1 day", keep="5 days"), REVISION_TABLES, late=F.expr(LATE))
    _same(keyed, steps, keyed.columns)


@pytest.mark.parametrize("lookback", [DAY / 2, 2 * DAY])
def test_ticks_by_steps(spark, lookback):
    """Late samples are counted once and told of at the next tick."""
    keyed = streams.arrivals(spark, SF, lambda ev: stream_at_ticks(streams._wrapping(ev), 21_600, DAY, lookback), late=F.expr(LATE))
    steps = streams.arrivals_in_steps(spark, SF, streams._wrapping, tick_step(21_600, DAY, lookback), TICK_TABLES, late=F.expr(LATE))
    rounded = [F.round(c, 6).alias(c) for c in ("value", "rate")]
    _same(keyed, steps, ["node", "metric", "tick", "sample_us", *rounded, "late"])
    assert steps.agg(F.sum("late")).first()[0] > 0


def test_chain_by_steps(spark):
    """Rates, alignment, losses, trust and cordon flags over three runs of one checkpoint."""
    model = Reconstruction(np.full(40, 0.5), np.eye(40)[:, :16])
    scales = [F.lit(x).alias(f"{m}_{end}") for m, top in streams._SCALES.items() for end, x in (("min", 0.0), ("max", top))]
    args = (spark.range(1).select(*scales), model, streams._LIMIT, streams._RANGE_S, DAY)
    keyed = streams.arrivals(spark, SF, lambda ev: stream_detect_v2(ad.chain_samples(ev), *args))
    tables = RATE_TABLES + ALIGN_TABLES + TRUST_TABLES
    steps = streams.arrivals_in_steps(spark, SF, ad.chain_samples, detect_v2_step(*args), tables)
    _same(keyed, steps, [F.round("loss", 6), *[c for c in keyed.columns if c != "loss"]])


def test_busy_node_by_steps(spark):
    """Nine tenths of the rows are one node's, cut many times in each of three micro-batches."""

    def records(ev):
        return ad.records(ad.busy_node(ev)).select("node", "ts", "event_id", "is_anomaly", "tampered")

    order = ("ts", "event_id")
    steps = streams.arrivals_in_steps(spark, SF, records, trust_step(order=order, rows_per_chunk=40), ("trust",))
    whole = status_transitions(trust_scores(records(ad.events(spark, SF)), order=order, tampered="tampered"), "tampered")
    _same(whole, steps, ["node", "event_id", "score", "status", "action"])


def test_labels_by_steps(spark):
    """Rows and windows behind closed cells are told; rows without a time get the default."""

    def rows(ev):
        moment = F.when(F.col("event_id") % 50 != 7, F.unix_timestamp("ts"))
        return ev.select("event_id", "node", "ts", moment.alias("epoch"))

    windows = ad.scenario_windows
    keyed = streams.arrivals(spark, SF, lambda ev: stream_labels(rows(ev), windows(ev), "1 hour", 3600, 2), late=F.expr(LATE))
    build = lambda ev: label_input(rows(ev), windows(ev))
    steps = streams.arrivals_in_steps(spark, SF, build, label_step("1 hour", 3600), LABEL_TABLES, late=F.expr(LATE))
    _same(labeled_rows(keyed), labeled_rows(steps), ["event_id", "node", "ts", "epoch", "label", "late"])
    _same(late_windows(keyed), late_windows(steps), ["pos", "label", "cell"])


def test_zero_rows_by_steps(spark):
    """A silent node is filled up to the latest closed window; a row behind its zeros is told as late."""

    def features(*rows):
        made = spark.createDataFrame(list(rows), "node STRING, s LONG, n LONG")
        return made.select("node", F.timestamp_seconds("s").alias("window_start"), "n")

    step = dense_step(10, ["n"])
    cells = ["node", F.unix_timestamp("window_start").cast("long"), "n", "late"]
    out, state = step(features(("a", 0, 5), ("a", 20, 7), ("b", 10, 1)), {})
    first = sorted(map(tuple, out.select(*cells).collect()))
    assert first == [("a", 0, 5, False), ("a", 10, 0, False), ("a", 20, 7, False), ("b", 10, 1, False), ("b", 20, 0, False)]
    out, _ = step(features(("b", 20, 3), ("c", 30, 2)), state)
    assert sorted(map(tuple, out.select(*cells).collect())) == [("a", 30, 0, False), ("b", 20, 3, True), ("b", 30, 0, False), ("c", 30, 2, False)]
