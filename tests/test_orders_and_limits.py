"""Equal times, parameter frames, strict lines, window files and payloads."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetsight.operators import timeseries as ts
from fleetsight.operators.events import densify
from fleetsight.operators.forest import sample_per_tree
from fleetsight.operators.labeling import label_by_windows
from fleetsight.plans.ordered import ROWS_PER_CHUNK_CONF
from fleetsight.sources.lines import parse_metric_lines
from fleetsight.sources.payloads import parse_instant_vector
from fleetsight.sources.tables import read_scenario_windows


def test_one_parameter_row_or_one_per_key(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "node STRING, v DOUBLE")
    one = spark.createDataFrame([(5.0,)], "limit DOUBLE")
    assert {r.limit for r in ts.with_params(rows, one).collect()} == {5.0}
    with pytest.raises(PySparkException, match="more than one row"):
        ts.with_params(rows, one.union(one)).collect()
    assert ts.with_params(rows, one.limit(0)).count() == 0
    keyed = spark.createDataFrame([("a", 7.0), ("b", 8.0)], "node STRING, limit DOUBLE")
    got = ts.with_params(rows, keyed, on=["node"]).select("node", "v", "limit")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1.0, 7.0), ("b", 2.0, 8.0)]
    with pytest.raises(PySparkException, match="more than one row"):
        ts.with_params(rows, keyed.union(keyed), on=["node"]).collect()


@pytest.mark.parametrize("frame_rows", [0, 50])
def test_equal_times_give_one_answer(spark, monkeypatch, frame_rows):
    monkeypatch.setattr(ts, "FRAME_ROWS", frame_rows)
    rng = random.Random(3)
    rows = [("n", float(t // 3), rng.randint(0, 40)) for t in range(90)]
    answers = set()
    for chunk in ("1000000", "20"):
        for _ in range(2):
            rng.shuffle(rows)
            df = spark.createDataFrame(rows, "instance STRING, s DOUBLE, value LONG")
            df = df.repartition(rng.randint(1, 6)).withColumn("ts", F.timestamp_seconds("s")).drop("s")
            ticks = df.select("instance", F.col("ts").alias("tick")).distinct()
            spark.conf.set(ROWS_PER_CHUNK_CONF, chunk)
            try:
                frames = [
                    ts.counter_rate(df, 6).select("ts", "value", "rate"),
                    ts.instant_rate(df, 6).select("ts", "value", "rate"),
                    ts.asof_latest(df, ticks, 6).select("tick", "value"),
                    ts.rate_at_ticks(df, ticks, 6).select("tick", "rate"),
                ]
                answers.add(str([sorted(map(str, f.collect())) for f in frames]))
            finally:
                spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert len(answers) == 1


def test_trees_sample_alike_at_every_size(spark):
    for n in (100, 3_000, 40_000):
        df = spark.range(n).withColumn("v", F.col("id").cast("double"))
        got = sample_per_tree(df, ["v"], ["id"], n, trees=5, sample=64).groupBy("tree").count().collect()
        assert sorted((r.tree, r["count"]) for r in got) == [(t, 64) for t in range(5)]
    same = sample_per_tree(df, ["v"], ["id"], n, trees=5, sample=64)
    again = sample_per_tree(df.repartition(7), ["v"], ["id"], n, trees=5, sample=64)
    assert sorted(map(tuple, same.select("tree", "rn", "x").collect())) == sorted(map(tuple, again.select("tree", "rn", "x").collect()))


def test_metric_lines_take_any_number_and_no_single_quotes(spark):
    lines = [
        '{"node": "a", "net_in": 7.0, "net_out": 3.5}', '{"node": "b", "net_in": 7, "net_out": 9007199254740993}',
        "{'node': 'x'}", '{"node": "c"} tail', '[{"node": "d"}]', '{"node": "e"}, {"node": "f"}', "{}", '{"node": {"k": [1]}}',
    ]
    got = parse_metric_lines(spark.createDataFrame([(x,) for x in lines], "raw STRING")).collect()
    assert [(r.node, r.net_in, r.net_out) for r in got[:2]] == [("a", 7.0, 3.5), ("b", 7.0, 9007199254740992.0)]
    assert [r.raw for r in got] == [lines[0], lines[1], lines[6], lines[7]]


def test_windows_of_several_files_keep_file_order(spark, tmp_path):
    head = "start_time,end_time,label,workload\n"
    (tmp_path / "a.csv").write_text(head + "0,100,first,w\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"0,100,later{i},w\n" for i in range(500)))
    windows = read_scenario_windows(spark, str(tmp_path))
    rows = spark.createDataFrame([(50,)], "epoch LONG")
    for limit in (10_000, 1):
        assert label_by_windows(rows, windows, array_limit=limit).first().label == "first"
        only = windows.where("label <> 'first'")
        assert label_by_windows(rows, only, array_limit=limit).first().label == "later0"


def test_instant_vectors_row_by_row(spark):
    def payload(*pairs, status="success"):
        cells = ", ".join(f'{{"metric": {m}, "value": [1, "{v}"]}}' for m, v in pairs)
        return f'{{"status": "{status}", "data": {{"result": [{cells}]}}}}'

    a, b = '{"instance": "a"}', '{"instance": "b"}'
    rows = [
        (1, payload((a, 1), (b, 2), (a, 3), ("{}", 4))), (2, payload((a, 1), (b, "x"))), (3, payload()),
        (4, payload((a, 1), status="error")), (5, "no json"), (6, None),
    ]
    got = parse_instant_vector(spark.createDataFrame(rows, "id INT, p STRING"), "p", by=["id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 3.0), (1, "b", 2.0), (1, "unknown", 4.0)]
    assert "Exchange" not in got._jdf.queryExecution().toString().replace("AdaptiveSparkPlan", "")


def test_grids_reach_back_to_a_stray_time(spark):
    bounds = spark.createDataFrame([("a", 0, 1_700_000_000), ("b", 95, 90), ("c", 5, 5), ("d", None, 9)], "k STRING, s LONG, e LONG")
    bounds = bounds.select("k", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    grid = ts.eval_grid(bounds, 1_000)
    got = grid.groupBy("k").agg(F.count("*"), F.countDistinct("tick"), F.unix_seconds(F.max("tick")))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1_700_001, 1_700_001, 1_700_000_000), ("c", 1, 1, 5)]
    rows = [("x", 0, 3), ("x", 1_700_000_000, 4), ("y", 1_699_999_990, 5)]
    feats = spark.createDataFrame(rows, "node STRING, s LONG, n LONG").select("node", F.timestamp_seconds("s").alias("window_start"), "n")
    dense = densify(feats, "1000 seconds", fill=["n"])
    assert dense.count() == 1_700_001 + 1 and dense.agg(F.sum("n")).first()[0] == 12
