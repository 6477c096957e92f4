"""Split keys must give the same running values as whole keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.operators import timeseries
from fleetsight.operators.timeseries import (
    asof_latest,
    counter_rate,
    instant_rate,
    make_sequences,
    rate_at_ticks,
    series_for_plot,
)
from fleetsight.operators.trust import V1, V2, cordon_trace, latch, trust_scores
from fleetsight.plans.ordered import (
    compose_prefixes,
    following,
    latest,
    ordered,
    position,
    previous,
    total,
)
from fleetsight.plans.quantiles import exact_quantile

SMALL = 25  # rows per chunk: node "a" is cut into many chunks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    t = 1_700_000_000
    for i in range(900):
        node = rng.choices(["a", "b", "c", "d", None], [0.6, 0.2, 0.1, 0.05, 0.05])[0]
        if rng.random() < 0.8:  # bursts and gaps
            t += rng.choice([1, 1, 2, 40])
        v = rng.randrange(100) if rng.random() < 0.9 else None
        data.append((node, t, i, v, rng.random() < 0.45, rng.random() < 0.01))
    df = spark.createDataFrame(
        data, "node STRING, t LONG, seq LONG, v LONG, is_anomaly BOOLEAN, tampered BOOLEAN"
    )
    return df.withColumn("ts", F.timestamp_seconds("t")).repartition(7).cache()


def same(a, b):
    cols = a.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted(map(tuple, a.select(*cols).collect()), key=key)
    right = sorted(map(tuple, b.select(*cols).collect()), key=key)
    assert len(left) == len(right)
    assert left == right


def test_chunks_are_bounded_and_complete(rows):
    laid = ordered(rows, ["node"], ["t", "seq"], SMALL)
    assert laid.split
    sizes = [r["count"] for r in laid.df.groupBy("node", "_chunk").count().collect()]
    assert sum(sizes) == 900
    assert len(sizes) > 20 and max(sizes) <= 8 * SMALL


def test_running_values(rows):
    def run(limit):
        return (
            ordered(rows, ["node"], ["t", "seq"], limit)
            .running(
                prev=previous(F.col("v")),
                last=latest(F.col("v")),
                nxt=following(F.col("v")),
                tot=total(F.col("v")),
                pos=position(),
            )
            .result()
        )

    same(run(10_000), run(SMALL))


def test_clamp_composition_matches_loop():
    rng = np.random.default_rng(3)
    d = rng.integers(-20, 20, 500).astype(float)
    lo = np.where(rng.random(500) < 0.1, -np.inf, -30.0)
    hi = np.where(rng.random(500) < 0.1, np.inf, 30.0)
    _, low, high = compose_prefixes(d, lo, hi)
    x = 5.0
    sums = np.cumsum(d)
    for i in range(500):
        x = min(hi[i], max(lo[i], x + d[i]))
        assert x == min(high[i], max(low[i], 5.0 + sums[i]))


def loop_trust(data, policy):
    out, score, seen = {}, {}, {}
    for node, t, seq, anomaly, tampered in data:
        before = score.get(node, 100.0)
        if tampered:
            after, seen[node] = 0.0, True
        elif anomaly:
            after = max(0.0, before - policy.decay)
        else:
            after = min(100.0, before + policy.recovery)
        score[node] = after
        out[seq] = (before, after, seen.get(node, False))
    return out


@pytest.mark.parametrize("limit", [10_000, SMALL])
@pytest.mark.parametrize("policy", [V1, V2])
def test_trust_matches_loop(rows, limit, policy):
    got = trust_scores(
        rows, policy, order=("t", "seq"), tampered="tampered", rows_per_chunk=limit
    ).collect()
    data = sorted(
        ((r.node, r.t, r.seq, r.is_anomaly, r.tampered) for r in rows.collect()),
        key=lambda r: (r[1], r[2]),
    )
    want = loop_trust(data, policy)
    assert len(got) == 900
    for r in got:
        assert (r.prev_score, r.score, r.compromised == 1.0) == want[r.seq]


def test_latch_and_hysteresis(rows):
    same(
        latch(rows, "tampered", order=("t", "seq"), rows_per_chunk=10_000),
        latch(rows, "tampered", order=("t", "seq"), rows_per_chunk=SMALL),
    )
    whole = cordon_trace(rows, V1, order=("t", "seq"), rows_per_chunk=10_000)
    cut = cordon_trace(rows, V1, order=("t", "seq"), rows_per_chunk=SMALL)
    same(whole, cut)
    score, flag, want = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.t, r.seq)):
        s = score.get(r.node, 100.0)
        s = max(0.0, s - 15) if r.is_anomaly else min(100.0, s + 2)
        score[r.node] = s
        old = flag.get(r.node, False)
        new = True if s < 40 else (False if s > 60 else old)
        flag[r.node] = new
        want[r.seq] = (new, "CORDON" if new and not old else "UNCORDON" if old and not new else None)
    assert {r.seq: (r.cordoned, r.action) for r in whole.collect()} == want


@pytest.fixture(scope="module")
def counters(rows):
    return rows.where("v is not null").groupBy("node", "ts").agg(F.max("v").alias("value"))


def loop_rates(samples, span):
    by = {}
    for r in samples:
        by.setdefault(r.node, []).append((r.ts.timestamp(), r.value))
    out = {}
    for node, s in by.items():
        s.sort()
        for i, (t, _) in enumerate(s):
            j = next(k for k in range(i + 1) if s[k][0] >= t - span)
            grown = sum(
                b if b < a else b - a for (_, a), (_, b) in zip(s[j:i], s[j + 1 : i + 1])
            )
            out[node, t] = grown / (t - s[j][0]) if i > j else None
    return out


@pytest.mark.parametrize("limit,frame", [(10_000, 500), (10_000, 2), (SMALL, 500)])
def test_counter_rate(counters, limit, frame, monkeypatch):
    monkeypatch.setattr(timeseries, "FRAME_ROWS", frame)  # 2: too dense for a range frame
    got = counter_rate(counters, 60, key=["node"], rows_per_chunk=limit).collect()
    want = loop_rates(counters.collect(), 60)
    assert len(got) == len(want)
    for r in got:
        assert r.rate == pytest.approx(want[r.node, r.ts.timestamp()])


def test_other_series_operators(spark, rows, counters):
    same(
        instant_rate(counters, 30, key=["node"], rows_per_chunk=10_000),
        instant_rate(counters, 30, key=["node"], rows_per_chunk=SMALL),
    )
    bounds = counters.groupBy("node").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    from fleetsight.operators.timeseries import eval_grid

    ticks = eval_grid(bounds, 17)
    for fn, arg in ((asof_latest, 30), (rate_at_ticks, 60)):
        same(
            fn(counters, ticks, arg, key=["node"], rows_per_chunk=10_000),
            fn(counters, ticks, arg, key=["node"], rows_per_chunk=SMALL),
        )
    samples = sorted((r.node or "", r.ts, r.value) for r in counters.collect())
    for r in asof_latest(counters, ticks, 30, key=["node"], rows_per_chunk=SMALL).collect():
        seen = [s for s in samples if s[0] == (r.node or "") and s[1] <= r.tick]
        ok = seen and (r.tick - seen[-1][1]).total_seconds() <= 30
        assert r.value == (seen[-1][2] if ok else None)


@pytest.mark.parametrize("by", [("node",), ()])
def test_sequences(rows, by):
    def run(limit):
        return make_sequences(
            rows.na.fill(0, ["v"]), ["v", "t"], 10, by=by, order=("t", "seq"), rows_per_chunk=limit
        )

    whole = run(10_000)
    same(whole, run(SMALL))
    sizes = {r.node: r["count"] for r in rows.groupBy("node").count().collect()}
    want = sum(max(0, n - 10) for n in sizes.values()) if by else 890
    assert whole.count() == want


def test_global_index(rows):
    got = series_for_plot(
        rows, cols=("seq", "t"), order=("t", "seq"), global_index=True, rows_per_chunk=SMALL
    ).collect()
    ranked = sorted(got, key=lambda r: (r.t, r.seq))
    assert [r.time_step for r in ranked] == list(range(900))


@pytest.mark.parametrize("p", [0.0, 0.01, 0.37, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    got = exact_quantile(df, "x", p, buffer_rows=500).first()["quantile"]
    assert got == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_exact_quantile_between_two_heavy_values(spark):
    few = [0.1 + i / 1000 for i in range(300)]
    x = np.array([0.0] * 20_000 + few + [1.0] * 20_000)
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE").repartition(8)
    for p in (0.3, 20_000 / 40_299, 0.4999, 0.5, 0.501, 20_299.5 / 40_299, 0.7, 0.0, 1.0):
        got = exact_quantile(df, "x", p, buffer_rows=100).first()["quantile"]
        assert got == pytest.approx(np.quantile(x, p), abs=1e-12), p
