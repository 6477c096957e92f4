"""Streams whose input arrives in parts: late rows, a busy node and the chained detector."""

import pytest
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators.events import event_features
from fleetsight.operators.trust import status_transitions, trust_scores
from fleetsight.registry import streams
from fleetsight.schemas import EVENT_COUNTS
from fleetsight.sources.lines import parse_kernel_events
from fleetsight.streaming.late import dropped_rows, latest_revisions, stream_revisions
from fleetsight.streaming.sliced import stream_trust_sliced

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def revisions(spark):
    def build(ev):
        return stream_revisions(parse_kernel_events(ad.kernel_lines(ev)), "1 day", keep="5 days")

    return streams.arrivals(spark, SF, build, late=F.col("event_id") % 37 == 5).persist()


def test_no_row_is_lost_unseen(spark, revisions):
    parsed = parse_kernel_events(ad.kernel_lines(ad.events(spark, SF)))
    counted = latest_revisions(revisions).agg(F.sum("counted")).first()[0]
    dropped = dropped_rows(revisions).agg(F.sum("dropped")).first()[0]
    assert dropped > 0 and counted + dropped == parsed.count()


def test_late_rows_correct_windows(spark, revisions):
    """A window that was revised after it had closed ends with the counts of all its rows."""
    corrected = revisions.where("closed AND revision > 1").select("node", "window_start").distinct()
    untouched = corrected.join(dropped_rows(revisions), ["node", "window_start"], "left_anti")
    parsed = parse_kernel_events(ad.kernel_lines(ad.events(spark, SF)))
    whole = event_features(parsed, "1 day").join(untouched, ["node", "window_start"], "left_semi")
    got = latest_revisions(revisions, extra=()).join(untouched, ["node", "window_start"], "left_semi")
    cols = ["node", "window_start", *EVENT_COUNTS]
    want = sorted(map(tuple, whole.select(cols).collect()))
    assert want and sorted(map(tuple, got.select(cols).collect())) == want


def test_busy_node_is_spread(spark):
    def records(ev):
        return ad.records(ad.busy_node(ev)).select("node", "ts", "event_id", "is_anomaly", "tampered")

    trace = streams.arrivals(spark, SF, lambda ev: stream_trust_sliced(records(ev), order=("ts", "event_id"), slice_s=86_400), parts=2)
    scored = trust_scores(records(ad.events(spark, SF)), order=("ts", "event_id"), tampered="tampered")
    cols = ["node", "event_id", "prev_score", "score", "status", "prev_status", "action"]
    assert sorted(map(tuple, trace.select(cols).collect()), key=str) == sorted(
        map(tuple, status_transitions(scored, "tampered").select(cols).collect()), key=str
    )
    busy = trace.where("node = 'node-busy'").groupBy("task").count().collect()
    rows = sum(r["count"] for r in busy)
    assert rows > 0.85 * trace.count() and len(busy) > 4 and max(r["count"] for r in busy) < 0.5 * rows


def test_chain_has_all_outcomes(spark):
    got = streams.stream_detect_v2(spark, SF).collect()
    assert {r.status for r in got} == {"Anomaly", "Normal"}
    assert any(r.action == "CORDON" for r in got)
    assert all(0 <= r.score <= 100 for r in got)


def test_zero_rows_come_in_bounded_frames(spark, monkeypatch, tmp_path):
    """A node that was silent for long gets all of its windows, a bounded number at a time."""
    import pandas as pd

    from fleetsight.streaming import stateful

    monkeypatch.setattr(stateful, "BLOCK", 7)

    class Value:
        def __init__(self):
            self.cell = None

        def exists(self):
            return self.cell is not None

        def get(self):
            return self.cell

        def update(self, cell):
            self.cell = cell

    class Handle:
        def listTimers(self):
            return []

        def registerTimer(self, at):
            pass

        def getValueState(self, *_):
            return Value()

    processor = stateful._DensifyProcessor(1_000, ["n"])
    processor.init(Handle())
    starts = pd.to_datetime([0, 40_000, 99_000], unit="ms")
    frames = list(processor.handleInputRows(("a",), iter([pd.DataFrame({"node": "a", "window_start": starts, "n": [1, 2, 3]})]), None))
    assert max(map(len, frames)) == 7
    whole = pd.concat(frames)
    assert len(whole) == 100 and whole["n"].sum() == 6 and whole["n"].iloc[40] == 2 and whole["n"].iloc[99] == 3
