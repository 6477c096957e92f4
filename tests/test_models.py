"""Forest and reconstruction detectors by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.jobs.detect import (
    batch_report,
    detect_v2,
    latest_sequence_scores,
    plot_series,
    score_sequences,
)
from fleetsight.jobs.training import load_v1, load_v2, train_v1, train_v2, validate_v2
from fleetsight.operators.forest import average_path, fit_iforest, sample_per_tree, score_iforest
from fleetsight.operators.reconstruct import augment_noise, fit_reconstruction, sequence_mae
from fleetsight.operators.scaling import minmax_scale, standard_scale
from fleetsight.operators.timeseries import make_sequences

FEATS = ("cpu", "mem", "net_in", "net_out", "latency")


@pytest.fixture(scope="module")
def metrics(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, f"n{i % 3}", float(1.4 + rng.normal(0, 0.15)), float(19.8 + rng.normal(0, 0.13)),
         float(353_000 + rng.normal(0, 6800)), float(196_000 + rng.normal(0, 3800)),
         float(abs(rng.normal(3, 1))))
        for i in range(3000)
    ]
    return spark.createDataFrame(
        rows, "pos LONG, node STRING, " + ", ".join(f"{f} DOUBLE" for f in FEATS)
    ).cache()


PROBES = [
    ("normal", 1.5, 20.0, 350_000.0, 200_000.0, 3.5),
    ("cpu", 99.0, 20.0, 350_000.0, 200_000.0, 3.5),
    ("net", 1.5, 20.0, 90_000_000.0, 200_000.0, 3.5),
]


def test_forest(spark, metrics, tmp_path):
    model = train_v1(metrics, ["pos"], FEATS, path=str(tmp_path / "m"))
    probes = spark.createDataFrame(PROBES, "name STRING, " + ", ".join(f"{f} DOUBLE" for f in FEATS))
    scaled = standard_scale(probes, FEATS, model.scaler)
    got = {r.name: r.score for r in score_iforest(scaled, model.forest).collect()}
    assert got["cpu"] < got["normal"] and got["net"] < got["normal"]
    assert all(-1 - model.forest.offset <= s <= -model.forest.offset for s in got.values())

    trained = score_iforest(standard_scale(metrics, FEATS, model.scaler), model.forest)
    below = trained.where("score < 0").count()
    assert below == pytest.approx(30, abs=1)  # contamination 1 % of 3000
    summary = model.summary.first()
    assert summary.suggested_threshold == pytest.approx(summary.min_score - 0.05)

    again = load_v1(spark, str(tmp_path / "m"))
    same = {r.name: r.score for r in score_iforest(scaled, again.forest).collect()}
    assert same == got

    lines, totals = batch_report(standard_scale(metrics, FEATS, model.scaler), model.forest, 0.0)
    assert totals.first().anomalies == below
    assert lines.where("section = 1").count() == 3000
    series = plot_series(standard_scale(metrics, FEATS, model.scaler), model.forest, ["pos"])
    assert series.where("node = 'n1'").agg(F.max("time_step")).first()[0] == 999


def test_forest_does_not_depend_on_partitioning(metrics):
    a = fit_iforest(metrics, FEATS, ["pos"], trees=20)
    b = fit_iforest(metrics.repartition(5), FEATS, ["pos"], trees=20)
    assert a.offset == b.offset and np.array_equal(a.cut, b.cut)
    c = fit_iforest(metrics, FEATS, ["pos"], trees=20, seed=7)
    assert not np.array_equal(a.cut[:50], c.cut[:50])


@pytest.mark.parametrize("trees,sample", [(20, 256), (10, 16)])  # shared and disjoint draws
def test_samples(metrics, trees, sample):
    drawn = sample_per_tree(metrics, FEATS, ["pos"], 3000, trees, sample)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == trees and max(sizes) <= sample and sum(sizes) > 0.95 * trees * sample


def test_small_training_table(metrics):
    forest = fit_iforest(metrics.limit(40), FEATS, ["pos"], trees=10)
    assert forest.sample == 40
    assert score_iforest(metrics, forest).where("score is null").count() == 0


def test_average_path():
    assert (average_path(1), average_path(2)) == (0.0, 1.0)
    assert average_path(256) == pytest.approx(10.244, abs=1e-3)


V2_FEATS = ("cpu", "mem", "net_in", "net_out")


@pytest.fixture(scope="module")
def rates(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        for node in ("w1", "w2", "k-control-plane"):
            rows.append((1_700_000_000 + 5 * i, node, float(rng.normal(0, 0.1)),
                         float(18 + rng.normal(0, 0.1)), float(abs(rng.normal(100, 10))),
                         float(abs(rng.normal(100, 10)))))
    df = spark.createDataFrame(
        rows, "t LONG, instance STRING, cpu DOUBLE, mem DOUBLE, net_in DOUBLE, net_out DOUBLE"
    )
    return df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t").cache()


def test_reconstruction_equals_svd(rates):
    seqs = make_sequences(rates, V2_FEATS, 10, order=["timestamp"])
    model = fit_reconstruction(seqs)
    x = np.array([np.ravel(r.seq) for r in seqs.collect()])
    centered = x - x.mean(axis=0)
    v = np.linalg.svd(centered, full_matrices=False)[2][:8].T
    want = np.abs(centered - centered @ v @ v.T).mean(axis=1)
    assert model.loss(x) == pytest.approx(want, rel=1e-6)


def test_sequence_detector(spark, rates, tmp_path):
    model = train_v2(rates, path=str(tmp_path / "s"))
    again = load_v2(spark, str(tmp_path / "s"))
    assert np.allclose(model.model.components, again.model.components)
    thr = again.threshold.first().threshold
    flat = [("normal", i, 0.0, 18.0, 100.0, 100.0) for i in range(10)]
    leak = [("leak", i, 0.0, 18 + 32 * i / 9, 100.0, 100.0) for i in range(10)]
    rows = spark.createDataFrame(flat + leak, "label STRING, i INT, cpu DOUBLE, mem DOUBLE, net_in DOUBLE, net_out DOUBLE")
    scaled = minmax_scale(rows, V2_FEATS, again.scaler)
    seqs = make_sequences(scaled, V2_FEATS, 10, drop_last=False, by=["label"], order=["i"])
    got = {r.label: r for r in validate_v2(seqs, again.model, thr).collect()}
    assert got["normal"].correct_normal == 1 and got["leak"].detected == 1

    scored = score_sequences(rates, again.scaler, again.model, again.threshold)
    assert scored.count() == 2 * 391  # control plane left out, last sequence kept
    trace = detect_v2(scored)
    assert trace.where("score < 40").count() == trace.where("cordoned").count() == 0


def test_noise_is_repeatable(rates):
    seqs = make_sequences(rates, V2_FEATS, 10, order=["timestamp"])
    noisy = augment_noise(seqs, ["instance", "timestamp"])
    again = augment_noise(seqs.repartition(3), ["instance", "timestamp"])
    key = lambda r: (r.instance, r.timestamp)
    a, b, c = (sorted(d.collect(), key=key) for d in (noisy, again, seqs))
    assert [r.seq for r in a] == [r.seq for r in b]
    diff = np.array([r.seq for r in a]) - np.array([r.seq for r in c])
    assert abs(diff.mean()) < 1e-3 and diff.std() == pytest.approx(0.01, rel=0.05)


def test_mae(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0]], [[1.0, 0.0], [0.0, 4.0]])],
        "a ARRAY<ARRAY<DOUBLE>>, b ARRAY<ARRAY<DOUBLE>>",
    )
    assert sequence_mae(df, "a", "b").first().mae == 1.25


def test_newest_points_of_every_metric(spark, rates):
    """Long samples per node and metric -> a verdict on the ten newest points."""
    model = train_v2(rates)
    cols = ", ".join(f"'{f}', {f}" for f in V2_FEATS)
    series = rates.selectExpr(
        "instance AS node", "timestamp AS ts", f"stack(4, {cols}) AS (metric, value)"
    )
    short = series.where("node = 'w1'").orderBy("ts").limit(12).withColumn("node", F.lit("w3"))
    parts = series.unionByName(short)  # w3 has three points of each metric: left out
    got = latest_sequence_scores(parts, model.scaler, model.model, model.threshold).collect()
    assert {r.node for r in got} == {"w1", "w2"}
    scored = score_sequences(rates, model.scaler, model.model, model.threshold)
    newest = scored.groupBy("instance").agg(F.max_by("loss", "timestamp").alias("loss")).collect()
    want = {r.instance: r.loss for r in newest}
    for r in got:
        assert r.loss == pytest.approx(want[r.node])


def test_training_rows_walk_the_trees_once(spark, monkeypatch):
    """Scores come with the fit, from one scoring, and equal those of a second one."""
    from fleetsight.operators import forest as forests

    rows = spark.range(3_000, numPartitions=3).select("id", *[(F.xxhash64("id", F.lit(f)) % 1000 / 7).alias(f) for f in FEATS])
    asked = []
    monkeypatch.setattr(forests, "score_iforest", lambda *a, **kw: asked.append(1) or score_iforest(*a, **kw))
    fitted, scored = forests.fit_and_score_iforest(rows, FEATS, ["id"], ["id"], trees=5)
    got = {r.id: r.score for r in scored.collect()}
    assert len(asked) == 1
    assert "pythonUDF" not in scored._jdf.queryExecution().executedPlan().toString()  # stored, not asked again
    assert got == {r.id: r.score for r in score_iforest(rows, fitted).collect()}
    assert 0 < sum(s < 0 for s in got.values()) <= 30  # the contamination's share
