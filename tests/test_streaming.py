"""Streams must end where the batch operators do, whatever the micro-batches."""

import pytest
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators.events import densify, event_features
from fleetsight.operators.reconstruct import fit_reconstruction
from fleetsight.operators.timeseries import make_sequences
from fleetsight.operators.trust import status_transitions, trust_scores
from fleetsight.sources.lines import parse_kernel_events, parse_metric_lines
from fleetsight.sources.tables import read_state
from fleetsight.streaming.features import complete_dense, stream_event_features
from fleetsight.streaming.run import run_bounded, stream_actions, stream_to_table
from fleetsight.streaming.stateful import (
    ROCKSDB,
    STATE_STORE_CONF,
    stream_densify,
    stream_sequence_scores,
    stream_trust_keyed,
)
from fleetsight.streaming.trust import stream_trust

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return ad.load(spark, SF, "events")


@pytest.fixture(scope="module")
def slices(table, tmp_path_factory):
    """The table in five files in time order, one micro-batch each."""
    import os

    path = tmp_path_factory.mktemp("slices")
    ranked = table.withColumn("_p", F.floor(F.col("event_id") / 200).cast("int"))
    for i in range(5):
        part = path / f"tmp{i}"
        ranked.where(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(str(part))
        file = next(part.glob("part-*.parquet"))
        os.makedirs(path / "in", exist_ok=True)
        target = path / "in" / f"slice-{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return str(path / "in")


@pytest.fixture
def stream(spark, table, slices):
    raw = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(slices)
    )
    return ad.shape_events(raw)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    yield
    spark.conf.unset(STATE_STORE_CONF)


def run(spark, df, tmp_path):
    query = stream_to_table(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run_bounded(query)
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


TRACE = ("node", "event_id", "score", "status", "prev_status", "action")


def batch_trace(spark):
    records = ad.records(ad.events(spark, SF))
    scored = trust_scores(records, order=("ts", "event_id"), tampered="tampered")
    return status_transitions(scored, "tampered")


@pytest.mark.parametrize("limit", [None, 9])
def test_trust_micro_batches(spark, stream, tmp_path, limit):
    query = stream_trust(
        ad.records(stream),
        str(tmp_path),
        str(tmp_path / "cp"),
        order=("ts", "event_id"),
        rows_per_chunk=limit,
    )
    run_bounded(query)
    trace = spark.read.parquet(str(tmp_path / "trace"))
    assert trace.select("batch").distinct().count() == 5
    assert rows(trace, *TRACE) == rows(batch_trace(spark), *TRACE)
    state = {r.node: (r.score, r.status) for r in read_state(spark, f"{tmp_path}/state").collect()}
    want = {}
    for r in sorted(batch_trace(spark).collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.node] = (r.score, r.status)
    assert state == want


def test_keyed_trust(spark, stream, tmp_path, rocksdb):
    traced = stream_trust_keyed(ad.records(stream), order=("ts", "event_id"))
    out = run(spark, traced, tmp_path)
    assert rows(out, *TRACE) == rows(batch_trace(spark), *TRACE)


def test_actions_stream(spark, stream, tmp_path, rocksdb):
    traced = stream_trust_keyed(ad.records(stream), order=("ts", "event_id"))
    run_bounded(stream_actions(traced, str(tmp_path / "out"), str(tmp_path / "cp")))
    out = spark.read.schema(traced.schema).parquet(str(tmp_path / "out"))
    want = batch_trace(spark).where("action is not null")
    assert rows(out, "node", "event_id", "action") == rows(want, "node", "event_id", "action")


FEATURES = (
    "node", "window_start", "exec_count", "unique_process_count", "tmp_exec_count",
    "outbound_connect_count", "mining_port_count",
)


def closed(df, width, end):
    return df.where(F.col("window_start") + F.expr(f"INTERVAL {width}") <= end)


def test_features(spark, stream, tmp_path):
    out = run(
        spark, stream_event_features(parse_kernel_events(ad.kernel_lines(stream)), "6 hours"), tmp_path
    )
    kernel = parse_kernel_events(ad.kernel_lines(ad.events(spark, SF)))
    watermark = kernel.agg(F.max("ts") - F.expr("INTERVAL 10 SECONDS")).first()[0]
    want = closed(event_features(kernel, "6 hours"), "6 hours", F.lit(watermark))
    assert want.count() > 400
    assert rows(out, *FEATURES) == rows(want, *FEATURES)


def test_zero_fill(spark, stream, tmp_path, rocksdb):
    kernel = parse_kernel_events(ad.kernel_lines(stream))
    dense = stream_densify(stream_event_features(kernel, "1 day"), 86_400)
    out = run(spark, dense, tmp_path).select(*FEATURES)
    kernel = parse_kernel_events(ad.kernel_lines(ad.events(spark, SF)))
    want = densify(event_features(kernel, "1 day"), "1 day").select(*FEATURES)
    got, full = set(rows(out, *FEATURES)), set(rows(want, *FEATURES))
    assert len(got) == out.count()  # nothing twice
    assert got <= full
    # only windows that the watermark has not closed may be missing
    last = want.agg(F.max("window_start")).first()[0]
    missing = {r[1] for r in full - got}
    assert all((last - w).days <= 2 for w in missing)
    zero = [r for r in got if not any(r[2:])]
    assert zero


def test_zero_fill_query_is_whole(spark):
    """The open windows and the nodes first seen in them are there: the same rows as in batch."""
    from fleetsight.registry import QUERIES

    got, want = (QUERIES[n](spark, SF) for n in ("stream_densify", "densify"))
    assert rows(got, *FEATURES) == rows(want, *FEATURES)


def test_late_row_replaces_zero_row(spark):
    def frame(days, late=""):
        made = ", ".join(
            f"('{n}', timestamp'2024-01-0{d}', {c}L, {c}L, 0L, 0L, 0L{x})" for n, d, c, x in days
        )
        return spark.sql(f"SELECT * FROM VALUES {made} AS t({', '.join(FEATURES)}{late})")

    no, yes = ", false", ", true"
    dense = frame([("a", 1, 4, no), ("a", 2, 0, no), ("a", 3, 0, no), ("a", 2, 7, yes)], ", late")
    out = complete_dense(dense, frame([("b", 4, 2, ""), ("c", 5, 1, "")]), "1 day")
    got = [(r.node, r.window_start.day, r.exec_count) for r in out.collect()]
    assert sorted(got) == [
        ("a", 1, 4), ("a", 2, 7), ("a", 3, 0), ("a", 4, 0), ("a", 5, 0), ("b", 4, 2), ("b", 5, 0), ("c", 5, 1),
    ]


def test_sequence_scores(spark, stream, tmp_path, rocksdb):
    points = ad.events(spark, SF).withColumn("k", F.col("k").cast("double"))
    seqs = make_sequences(points, ["value", "k"], 10, by=["node"], drop_last=False)
    model = fit_reconstruction(seqs)
    out = run(spark, stream_sequence_scores(stream, model, ["value", "k"]), tmp_path)
    import numpy as np

    want = {}
    for r in seqs.collect():
        want.setdefault(r.node, []).append((r.ts, model.loss(np.ravel(r.seq)[None, :])[0]))
    got = {}
    for r in out.collect():
        got.setdefault(r.node, []).append((r.ts, r.loss))
    assert got.keys() == want.keys()
    for node in want:
        a = [x[1] for x in sorted(got[node])]
        b = [x[1] for x in sorted(want[node])]
        assert a == pytest.approx(b)


def test_metric_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ad.metric_lines(ad.events(spark, SF), "s").select("raw")
    lines.coalesce(1).write.text(str(tmp_path / "in" / "a"))
    from fleetsight.sources.lines import read_metric_lines

    out = run(spark, read_metric_lines(spark, str(tmp_path / "in" / "a"), streaming=True), tmp_path)
    assert out.count() == parse_metric_lines(lines).count()


def test_params_join_and_staleness_on_a_stream(spark, stream, tmp_path):
    """One-row parameters join a stream; records of the past are stale by the wall clock."""
    from fleetsight.operators.predicates import classify, drop_stale, stale_records
    from fleetsight.operators.timeseries import with_params

    params = spark.createDataFrame([(25.0,)], "threshold DOUBLE")
    records = stream.withColumn("timestamp", F.unix_micros("ts") / 1_000_000)
    judged = classify(with_params(records, params), "value", F.col("threshold"), "high")
    out = run(spark, judged, tmp_path)
    table = ad.events(spark, SF)
    assert out.where("status = 'Anomaly'").count() == table.where("value > 25").count()
    old = run(spark, stale_records(records), tmp_path / "old")
    assert old.count() == table.count()
    assert run(spark, drop_stale(records), tmp_path / "new").count() == 0


def test_kernel_event_files(spark, tmp_path):
    from fleetsight.sources.lines import read_kernel_events

    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"process_exec": {"process": {"binary": "/tmp/x"}}, "node_name": "n", "time": "%s"}'
    stamps = ["2024-01-01T00:00:01.5Z", "2024-01-01T00:00:11Z", "2024-01-01T00:01:00Z"]
    (folder / "a.log").write_text("\n".join(line % s for s in stamps) + "\nnoise\n\n")
    batch = event_features(read_kernel_events(spark, str(folder)), ts="event_time")
    assert batch.where("tmp_exec_count = 1").count() == 3
    events = read_kernel_events(spark, str(folder), streaming=True)
    out = run(spark, stream_event_features(events, ts="event_time"), tmp_path)
    assert out.count() == 2  # the last window is still open
