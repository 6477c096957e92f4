"""Mergeable sketches: error bounds against exact answers, and merging in any order."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetsight.operators.sketches import recalibrated, roll_up, sketch_windows

ASKED = {"low_q": 0.01, "mid": 0.5, "high_q": 0.999}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 4, 4000), -rng.lognormal(2, 1, 1500), np.zeros(300), np.full(2000, 7.25), [1e300, -1e-300]])
    rng.shuffle(x)
    return pd.DataFrame({"node": None, "sec": np.arange(len(x)) * 11, "x": x, "item": [f"i{v}" for v in rng.integers(0, 6000, len(x))]})


@pytest.fixture(scope="module")
def rows(spark, values):
    df = spark.createDataFrame(values.drop(columns="node")).withColumn("node", F.when(F.col("sec") % 2 == 0, "a"))
    return df.withColumn("ts", F.timestamp_seconds("sec")).persist()


def test_bounds_against_exact_answers(rows, values):
    got = recalibrated(sketch_windows(rows, "x", "item"), ASKED).collect()
    assert len(got) == 1
    x = np.sort(values["x"].to_numpy())
    for name, p in ASKED.items():
        exact = x[math.floor(p * (len(x) - 1))]
        assert abs(got[0][name] - exact) <= 0.005 * abs(exact) * (1 + 1e-9), name
    distinct = values["item"].nunique()
    assert got[0]["n"] == len(x) and abs(got[0]["distinct"] - distinct) < 5 * distinct / math.sqrt(1022)


def test_rolled_up_equals_made_from_rows(rows):
    """Buckets and hashes are the same rows; moments up to rounding. Null keys are keys."""
    small = rows.where("abs(x) < 1000")
    fine = roll_up(roll_up(sketch_windows(small, "x", "item", ["node"], "5 minutes", k=64), "1 hour", ["node"], k=64), "1 day", ["node"], k=64)
    whole = sketch_windows(small, "x", "item", ["node"], "1 day", k=64)
    cols = ["node", "window_start", "kind", "slot", "n"]
    assert sorted(map(str, fine.select(cols).collect())) == sorted(map(str, whole.select(cols).collect()))
    a, b = (
        {r.node: r for r in recalibrated(s, ASKED, ["node"], k=64).collect()} for s in (fine, whole)
    )
    assert set(a) == set(b) == {None, "a"}
    for node in a:
        assert a[node]["distinct"] == b[node]["distinct"]
        for c in ("mean", "std", "threshold", *ASKED):
            assert math.isclose(a[node][c], b[node][c], rel_tol=1e-9)
    exact = small.groupBy("node").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    for r in exact:
        assert math.isclose(a[r.node]["mean"], r.m, rel_tol=1e-9) and math.isclose(a[r.node]["std"], r.s, rel_tol=1e-9)


def test_defined_cases(spark):
    schema = "node STRING, ts TIMESTAMP, x DOUBLE, item STRING, n INT"
    t = datetime(2024, 1, 1)
    cells = [("a", t, None, None, 1), ("a", t, float("nan"), "p", 1), ("a", t, float("inf"), "p", 2), ("b", t, 2.0, None, 3), ("c", None, 1.0, "q", 4)]
    df = spark.createDataFrame(cells, schema)
    got = {r.node: r for r in recalibrated(sketch_windows(df, "x", "item", ["node"]), ASKED, ["node"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].n, got["a"].mid, got["a"].distinct) == (0, None, 1)
    assert (got["b"].n, got["b"].mid, got["b"].std, got["b"].distinct) == (1, 2.0, 0.0, 0)
    empty = sketch_windows(df.limit(0), "x", "item", ["node"])
    assert empty.count() == 0 and recalibrated(empty, ASKED, ["node"]).count() == 0
