"""Sources, signatures and sinks."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from fleetsight import schemas
from fleetsight.functions.signing import canonical_json, sign_text, verify_signature
from fleetsight.jobs.datasets import build_labeled_dataset, collect_v1, metric_rows_v2
from fleetsight.jobs.detect import detect_v1
from fleetsight.operators.labeling import label_totals
from fleetsight.sinks.tables import append_table, publish_state, write_report, write_table
from fleetsight.sources.lines import parse_metric_lines, read_metric_lines
from fleetsight.sources.payloads import parse_instant_vector
from fleetsight.sources.tables import (
    load_threshold,
    read_metrics_csv,
    read_node_features_csv,
    read_scenario_windows,
    read_state,
    resolve_policy,
)

SECRET = "k"


def signed(record, secret=SECRET):
    text = json.dumps(record, sort_keys=True)
    return json.dumps({**record, "signature": sign_text(text, secret)})


RECORD = {
    "node": "n1", "timestamp": 1768907356.321367, "cpu": 1.6, "mem": 20.1, "net_out": 1037475,
    "net_in": 1875095, "latency": 2.9802322387695312,
}


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "raw STRING")


def test_signatures(spark):
    lines = [
        signed(RECORD),
        signed({**RECORD, "cpu": 0.00001, "note": "é"}),
        signed(RECORD, "other"),
        json.dumps(RECORD),
        signed(RECORD).replace("1.6", "1.7"),
        signed(RECORD).replace('"signature": "', '"signature": 5, "x": "'),
    ]
    got = lines_df(spark, lines).select(verify_signature(F.col("raw"), SECRET)).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False]
    text = lines_df(spark, lines[:1]).select(canonical_json(F.col("raw"), "signature")).first()[0]
    assert text == json.dumps(RECORD, sort_keys=True)


def test_detection_order_of_checks(spark):
    """Stale first, then node, signature, features; a tampered record needs no features."""
    now = 1000.0

    def rec(node, age, cpu=1.0, **kw):
        r = {"node": node, "timestamp": now - age, "cpu": cpu, "mem": 1.0, "net_out": 1,
             "net_in": 1, "latency": 1.0, **kw}
        return {k: v for k, v in r.items() if v is not None}

    lines = [
        signed(rec("a", 1.5)),
        signed(rec("a", 5.5)),
        signed(rec("a", 1.4, cpu=99.0)),
        signed(rec("b", 1, latency=None)),
        signed(rec("c", 1, latency=None), "wrong"),
        signed(rec(None, 1)),
        signed(rec("d", -60)),
        "junk",
    ]
    trace = detect_v1(
        lines_df(spark, lines), SECRET, lambda: -F.col("cpu"), -50.0, now=F.lit(now)
    )
    got = sorted((r.node, r.raw_status, r.score, r.status, r.action) for r in trace.collect())
    assert got == [
        ("a", "Anomaly", 85.0, "Healthy", None),
        ("a", "Normal", 100.0, "Healthy", None),
        ("c", "Tampered", 0.0, "Compromised", "BAN"),
        ("d", "Normal", 100.0, "Healthy", None),
    ]


def test_metric_lines_from_files(spark, tmp_path):
    good = signed(RECORD)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(f"\n  {good}  \n5\n[1]\n{good[:40]}\nfree text\n")
    df = read_metric_lines(spark, str(tmp_path / "in"))
    assert [r.raw for r in df.collect()] == [good]
    collect_v1(df.select("raw"), str(tmp_path / "out"), "csv")
    collect_v1(df.select("raw"), str(tmp_path / "out"), "csv")
    back = read_metrics_csv(spark, str(tmp_path / "out"))
    assert back.count() == 2 and back.first().net_in == RECORD["net_in"]


def test_missing_field_is_null_and_extra_ignored(spark):
    row = parse_metric_lines(lines_df(spark, ['{"node": "x", "cpu": 2, "more": {"a": 1}}'])).first()
    assert (row.node, row.cpu, row.timestamp, row.signature) == ("x", 2.0, None, None)


def test_payload_defaults(spark):
    payload = json.dumps(
        {
            "status": "success",
            "data": {"result": [
                {"metric": {}, "value": [1, "2.5"]},
                {"metric": {"instance": "a:1"}, "value": [1, "1"]},
                {"metric": {"instance": "a:1"}, "value": [1, "3"]},
            ]},
        }
    )
    df = spark.createDataFrame([(payload,), ('{"status": "error"}',), ("x",)], "p STRING")
    got = {r.instance: r.value for r in parse_instant_vector(df, "p", "").collect()}
    assert got == {"": 2.5, "a:1": 3.0}


def test_collect_v2_rows(spark):
    def vec(**values):
        return json.dumps(
            {"status": "success", "data": {"result": [
                {"metric": {"instance": k}, "value": [1, str(v)]} for k, v in values.items()]}}
        )

    rows = [(7, "cpu", vec(a=1)), (7, "mem", vec(b=2)), (7, "net_in", vec(a=3, c=9))]
    df = spark.createDataFrame(rows, "timestamp INT, metric STRING, payload STRING")
    got = {tuple(r) for r in metric_rows_v2(df).collect()}
    assert got == {(7, "a", 1.0, 0.0, 3.0, 0.0), (7, "b", 0.0, 2.0, 0.0, 0.0)}


def test_policies(spark):
    rows = [("a", None, None, None, None, None), ("b", 0, 1.0, 1.0, "log", False),
            ("c", 5, 85.0, 2.0, "cordon", False), ("d", 5, 1.0, 1.0, "nuke", True)]
    df = spark.createDataFrame(rows, schemas.POLICY)
    got = [tuple(r) for r in resolve_policy(df).orderBy("name").collect()]
    assert got == [("a", 10, 90.0, 5.0, "cordon", True), ("c", 5, 85.0, 2.0, "cordon", False)]
    with pytest.raises(Exception, match="invalid policy"):
        resolve_policy(df, on_invalid="fail").collect()


def test_labeled_dataset(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "start_time,end_time,label,workload\n0,100,cpu_stress,f.yaml\n0,200,normal_recovery,baseline\n"
    )
    windows = read_scenario_windows(spark, str(tmp_path / "w.csv"))
    feats = spark.createDataFrame(
        [("1970-01-01T00:00:20.5Z", "n", 1), ("1970-01-01T00:03:00", "n", 2),
         ("1970-01-01T01:00:00", "n", 3)], "timestamp STRING, node STRING, v INT"
    )
    totals = build_labeled_dataset(feats, windows, str(tmp_path / "out")).first()
    assert tuple(totals) == (3, 2)
    saved = spark.read.parquet(str(tmp_path / "out"))
    assert {r.v: r.label for r in saved.collect()} == {
        1: "cpu_stress", 2: "normal_recovery", 3: "normal",
    }
    assert label_totals(saved).first().total_rows == 3


def test_feature_csv_round_trip(spark, tmp_path):
    row = (None, "normal", "n", 1.0, 2.0, 3.0, 4.0, 5, 6, 7, 8, 9, {"b": 2, "a": 1})
    df = spark.createDataFrame([row], schemas.NODE_FEATURES)
    path = str(tmp_path / "t")
    write_table(df, path, df.columns, "csv")
    append_table(df, path, "csv")
    assert [tuple(r) for r in read_node_features_csv(spark, path).collect()] == [row, row]
    # Spark may write a part with nothing but the header for an empty partition.
    parts = [p.read_text().splitlines() for p in (tmp_path / "t").glob("part-*.csv")]
    rows = [cells for part in parts for cells in csv.reader(part[1:])]
    assert [json.loads(cells[-1]) for cells in rows] == [{"a": 1, "b": 2}] * 2
    windows = spark.createDataFrame([(0, 9, "x", 0)], "start_time LONG, end_time LONG, label STRING, pos INT")
    totals = build_labeled_dataset(df, windows, str(tmp_path / "labeled"), "csv").first()
    assert tuple(totals) == (1, 0)


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert read_state(spark, path).count() == 0

    def state(*rows):
        return spark.createDataFrame(rows, schemas.NODE_STATE)

    publish_state(state(("a", 5.0, 1.0, 100.0, "Healthy", "Normal")), 0, path)
    publish_state(state(("b", 6.0, 1.0, 85.0, "Healthy", "Anomaly")), 1, path)
    for _ in range(2):  # a replay changes nothing
        publish_state(state(("a", 4.0, 2.0, 70.0, "Probation", "Anomaly")), 2, path)
    got = {r.node: (r.score, r.status) for r in read_state(spark, path).collect()}
    assert got == {"a": (70.0, "Probation"), "b": (85.0, "Healthy")}
    (tmp_path / "state" / "v9").mkdir()  # unfinished
    assert read_state(spark, path).count() == 2


def test_threshold_default(spark, tmp_path):
    assert load_threshold(spark, str(tmp_path / "none")).first().threshold == 0.5


def test_report_file(spark, tmp_path):
    rows = [(i, "n", 1.0, 0.1, "Normal") for i in range(50)]
    df = spark.createDataFrame(rows, "pos INT, node STRING, cpu DOUBLE, score DOUBLE, status STRING")
    write_report(df, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    lines = text.splitlines()
    assert lines[0].startswith("Node") and lines[-1] == "Anomalies Detected: 0" and len(lines) == 55


def test_state_log_writes_what_changed(spark, tmp_path, monkeypatch):
    from fleetsight.sinks import tables

    monkeypatch.setattr(tables, "COMPACTED_ROWS", 50)
    path = str(tmp_path / "log")

    def rows(first, count, score):
        nodes = spark.range(first, first + count)
        return nodes.selectExpr(
            "concat('n', id) AS node", "CAST(id AS DOUBLE) AS last_seen", "1.0D AS cpu", f"{score}D AS score", "'Healthy' AS status", "'Normal' AS raw_status"
        )

    publish_state(rows(0, 200, 100.0), 0, path)
    publish_state(rows(5, 3, 85.0), 1, path)
    assert spark.read.parquet(f"{path}/d1").count() == 3
    publish_state(rows(5, 3, 85.0), 1, path)  # replayed
    want = {f"n{i}": 85.0 if 5 <= i < 8 else 100.0 for i in range(200)}
    assert {r.node: r.score for r in read_state(spark, path).collect()} == want
    # A writer that dies before its manifest leaves the state as it was.
    monkeypatch.setattr(tables, "_write_manifest", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        publish_state(rows(0, 200, 1.0), 2, path)
    monkeypatch.undo()
    monkeypatch.setattr(tables, "COMPACTED_ROWS", 50)
    assert {r.node: r.score for r in read_state(spark, path).collect()} == want
    for version in range(2, 8):  # deltas grow into a new base
        publish_state(rows(version * 50 - 100, 60, float(version)), version, path)
        want |= {f"n{i}": float(version) for i in range(version * 50 - 100, version * 50 - 40)}
        assert {r.node: r.score for r in read_state(spark, path).collect()} == want
    names = {p.name for p in (tmp_path / "log").iterdir()}
    assert any(n.startswith("b") for n in names) and "d0" not in names
    assert sorted(n for n in names if n.startswith("m")) == ["m5", "m6", "m7"]
