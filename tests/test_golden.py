"""Golden values: verdict counts, trust traces, transitions, labels, features, text reports."""

import pytest
from pyspark.sql import functions as F

from fleetsight.functions import scalars as S
from fleetsight.operators import labeling
from fleetsight.operators.events import event_features, event_histogram
from fleetsight.operators.labeling import label_by_windows, window_cells
from fleetsight.operators.predicates import bad_nodes, classify
from fleetsight.operators.scaling import detection_totals, minmax_scale, standard_scale
from fleetsight.operators.trust import V1, V2, cordon_trace, status_transitions, trust_scores
from fleetsight.sinks.tables import detection_report
from fleetsight.sources.lines import parse_kernel_events

# Fixed values: (node, cpu, score) of a scored batch in file order.
W, X = "kind-worker", "kind-worker2"
SCORED = [
    (W, 1.6, 0.055), (W, 1.2, 0.010), (W, 1.2, 0.027), (W, 1.4, 0.059), (W, 1.2, 0.035),
    (W, 1.2, 0.039), (W, 1.1, 0.033), (W, 4.7, -0.015), (X, 1.6, 0.057), (X, 1.2, 0.032),
    (X, 1.2, 0.039), (X, 1.4, 0.065), (X, 1.2, 0.045), (W, 7.6, -0.061), (W, 8.2, -0.053),
    (X, 1.2, 0.035), (X, 1.1, 0.037), (X, 4.7, -0.019), (X, 7.7, -0.058), (X, 8.2, -0.053),
    (W, 8.3, -0.015), (X, 8.3, -0.015), (W, 7.6, -0.012), (X, 7.6, -0.018), (W, 7.7, -0.012),
    (X, 7.8, -0.012), (X, 4.8, 0.012), (W, 4.8, 0.010), (W, 1.3, 0.117), (X, 1.3, 0.117),
    (X, 1.2, 0.069), (W, 1.2, 0.069), (W, 1.4, 0.121), (X, 1.4, 0.119), (W, 1.7, 0.108),
    (X, 1.7, 0.104), (X, 1.3, 0.120), (W, 1.3, 0.122), (X, 1.3, 0.118),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, *r) for i, r in enumerate(SCORED)]
    return spark.createDataFrame(rows, "pos INT, node STRING, cpu DOUBLE, score DOUBLE")


@pytest.mark.parametrize("threshold,want", [(-0.085, 0), (-0.045, 4), (0.0, 12), (0.08, 30)])
def test_verdict_counts(scored, threshold, want):
    row = detection_totals(classify(scored, "score", threshold)).first()
    assert (row.total_rows, row.anomalies) == (39, want)


def test_ties_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (0.6,), (None,)], "s DOUBLE")
    low = [r.status for r in classify(df, "s", 0.5, "low").collect()]
    high = [r.status for r in classify(df, "s", 0.5, "high").collect()]
    assert low == ["Anomaly", "Anomaly", "Normal", "Anomaly"]
    assert high == ["Normal", "Normal", "Anomaly", "Normal"]


def test_trust_traces(scored):
    flagged = classify(scored, "score", -0.045).withColumn(
        "is_anomaly", F.col("status") == "Anomaly"
    )
    flagged = flagged.drop("status", "score")
    v1 = status_transitions(trust_scores(flagged, V1, order=("pos",))).orderBy("pos").collect()
    v2 = trust_scores(flagged, V2, order=("pos",)).orderBy("pos").collect()
    tail1 = [85, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90]
    tail2 = [95, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99, 100]
    for node, n in ((W, 19), (X, 20)):
        assert [r.score for r in v1 if r.node == node] == ([100] * 8 + tail1)[:n]
        assert [r.score for r in v2 if r.node == node] == ([100] * 8 + tail2)[:n]
        acts = [(r.score, r.action) for r in v1 if r.node == node and r.action]
        assert acts == [(70, "TAINT"), (76, "UNTAINT")]


def trace(spark, letters, policy=V1):
    rows = [("n", i, c == "A", c == "T") for i, c in enumerate(letters)]
    df = spark.createDataFrame(rows, "node STRING, ts INT, is_anomaly BOOLEAN, tampered BOOLEAN")
    out = status_transitions(trust_scores(df, policy, tampered="tampered"), "tampered")
    return [(r.score, r.status, r.action) for r in out.orderBy("ts").collect()]


def test_transitions(spark):
    assert trace(spark, "AAAAA") == [
        (85, "Healthy", None),
        (70, "Probation", "TAINT"),
        (55, "Probation", None),
        (40, "Probation", None),
        (25, "Banned", "BAN"),
    ]
    long = trace(spark, "AAAAA" + "N" * 25)[5:]
    assert long[:3] == [(27, "Banned", None), (29, "Banned", None), (31, "Probation", None)]
    assert long[-1] == (75, "Healthy", "UNTAINT")
    assert not any(a and "UNCORDON" in a for _, _, a in long)
    assert trace(spark, "TNNT") == [
        (0, "Compromised", "BAN"),
        (2, "Compromised", None),
        (4, "Compromised", None),
        (0, "Compromised", "BAN"),
    ]
    assert trace(spark, "A" * 10)[-1][0] == 0.0


@pytest.mark.parametrize("auto", [True, False])
def test_cordon(spark, auto):
    def run(letters):
        rows = [("n", i, c == "A") for i, c in enumerate(letters)]
        df = spark.createDataFrame(rows, "node STRING, ts INT, is_anomaly BOOLEAN")
        last = cordon_trace(df, V2, auto_remediate=auto).orderBy(F.desc("ts")).first()
        return last.score, last.cordoned, last.action

    assert run("A" * 12) == (40.0, False, None)
    assert run("A" * 13) == (35.0, True, "CORDON")
    assert run("A" * 13 + "N" * 25) == (60.0, True, None)
    want = (61.0, False, "UNCORDON") if auto else (61.0, True, None)
    assert run("A" * 13 + "N" * 26) == want


WINDOWS = [(1000, 1300, "normal", 0), (1300, 1420, "cpu_stress", 1), (1430, 1550, "memory_leak", 2)]
EPOCHS = {
    1005: "normal", 1310: "normal", 1315: "normal", 1316: "cpu_stress", 1435: "cpu_stress",
    1437: "normal", 1440: "memory_leak", 1565: "memory_leak", 1566: "normal",
}


@pytest.mark.parametrize("array_limit", [64, 0])
def test_labels(spark, array_limit):
    windows = spark.createDataFrame(
        WINDOWS, "start_time LONG, end_time LONG, label STRING, pos INT"
    )
    rows = spark.createDataFrame([(e,) for e in EPOCHS], "epoch LONG")
    got = label_by_windows(rows, windows, array_limit=array_limit)
    assert {r.epoch: r.label for r in got.collect()} == EPOCHS


def test_time_tree_equals_loop(spark):
    import random

    rng = random.Random(5)
    wins = []
    for pos in range(150):
        s = rng.randrange(0, 5000)
        wins.append((s, s + rng.choice([0, 3, 50, 700]), f"l{pos % 9}", pos))
    windows = spark.createDataFrame(wins, "start_time LONG, end_time LONG, label STRING, pos INT")
    rows = spark.createDataFrame([(e,) for e in range(0, 6000, 7)], "epoch LONG")
    got = {r.epoch: r.label for r in label_by_windows(rows, windows, array_limit=0).collect()}
    for e, label in got.items():
        hit = [w[2] for w in wins if w[0] + 10 <= e <= w[1] + 15]
        assert label == (hit[0] if hit else "normal")
    try:  # the shuffled form must agree as well
        limit, labeling.CELL_LIMIT = labeling.CELL_LIMIT, 0
        again = {r.epoch: r.label for r in label_by_windows(rows, windows, array_limit=0).collect()}
    finally:
        labeling.CELL_LIMIT = limit
    assert again == got
    padded = windows.selectExpr("start_time AS s", "end_time AS e", "label", "pos")
    assert window_cells(padded).count() <= 2 * 11 * len(wins)


KERNEL_LINES = [
    '{"process_exec": {"process": {"binary": "/usr/bin/a"}}, "node_name": "n"}',
    '{"process_exec": {"process": {"binary": "/tmp/x"}}, "node_name": "n"}',
    '{"process_exec": {"process": {"binary": "/dev/shm/y"}}, "node_name": "n"}',
    '{"process_exec": {"process": {"binary": "/tmp/x"}}, "node_name": "n"}',
    '{"process_kprobe": {"function_name": "tcp_connect", "args": [{"sock_arg": {"dport": 3333}}]},'
    ' "node_name": "n"}',
    '{"process_kprobe": {"function_name": "tcp_connect", "args": [{"sock_arg": {"dport": 4444}},'
    ' {"sock_arg": {"dport": 14444}}]}, "node_name": "n"}',
    '{"process_kprobe": {"function_name": "tcp_connect", "args": [{"sock_arg": {"dport": 443}}]},'
    ' "node_name": "n"}',
    '{"process_kprobe": {"function_name": "other", "args": [{"sock_arg": {"dport": 3333}}]},'
    ' "node_name": "n"}',
    "not json",
]


def kernel(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "raw STRING")
    return parse_kernel_events(df.withColumn("ts", F.timestamp_seconds(F.lit(100))))


def test_event_features(spark):
    events = kernel(spark, KERNEL_LINES)
    row = event_features(events).first()
    assert (
        row.exec_count,
        row.unique_process_count,
        row.tmp_exec_count,
        row.outbound_connect_count,
        row.mining_port_count,
    ) == (4, 3, 3, 3, 3)
    hist = event_histogram(events).first().syscall_feature_vector
    assert hist == {"process_exec": 4, "process_kprobe": 4}


def test_malformed_events(spark):
    lines = ["", "  ", "5", "[1]", "null", '{"process_exec": ', "{} {}", '{"a": 1} tail',
             '{"process_exec": {}, "node_name": "seen"}', "{}", '{"process_exec": {"process": {}}}']
    rows = kernel(spark, lines).select("node", "kind", "event_class", "binary").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            ("seen", "process_exec", None, ""),
            ("unknown", "unknown", "other", ""),
            ("unknown", "process_exec", "exec", ""),
        ],
        key=str,
    )
    counts = {r.node: r.exec_count for r in event_features(kernel(spark, lines)).collect()}
    assert counts == {"seen": 0, "unknown": 1}


def test_report(scored):
    lines = detection_report(classify(scored, "score", -0.045)).orderBy("section", "pos")
    text = "\n".join(r.line for r in lines.collect()).split("\n")
    assert text[0] == "Node            CPU    Score    Status"
    assert text[1] == "-" * 40
    assert text[2] == "kind-worker     1.6    0.055    Normal"
    assert text[15] == "kind-worker     7.6    -0.061   Anomaly <--- DETECTED"
    assert text[-3:] == ["-" * 40, "Total Rows: 39", "Anomalies Detected: 4"]


def test_fixed_decimals_round_as_printf(spark):
    values = [0.125, 6.55, 2.5, -0.061, 0.05, 1234567.25, 0.0, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(S.fixed_decimals(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_snapshot_has_no_bad_nodes(spark):
    rows = [(X, 84.0, "Healthy"), (W, 96.0, "Healthy"), ("c", 0.0, "Compromised")]
    state = spark.createDataFrame(rows, "node STRING, score DOUBLE, status STRING")
    assert bad_nodes(state).count() == 0
    assert bad_nodes(state, include_compromised=True).count() == 1


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in standard_scale(df, ["a", "b"]).collect()] == [(-1, 0), (1, 0)]
    assert [tuple(r) for r in minmax_scale(df, ["a", "b"]).collect()] == [(0, 0), (1, 0)]
    fit = df.limit(0)
    params = spark.createDataFrame([(0.0, 2.0, 5.0, 5.0)], "a_min DOUBLE, a_max DOUBLE, b_min DOUBLE, b_max DOUBLE")
    out = minmax_scale(df, ["a", "b"], params).collect()
    assert [tuple(r) for r in out] == [(0.5, 0.0), (1.5, 0.0)]  # not clipped
    assert fit.count() == 0
