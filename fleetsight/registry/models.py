"""Queries: signatures, end-to-end detection, fitted models and streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.functions.signing import verify_signature
from fleetsight.jobs.detect import detect_v1, detect_v2, score_sequences
from fleetsight.jobs.training import train_v1, train_v2
from fleetsight.operators import reconstruct as rec
from fleetsight.operators.forest import Forest, average_path, fit_and_score_iforest, score_iforest
from fleetsight.operators.predicates import classify
from fleetsight.operators.scaling import detection_totals, standard_scale
from fleetsight.operators.timeseries import make_sequences
from fleetsight.plans.kept import kept
from fleetsight.registry.base import KERNEL, LATEST, COUNT_NAMES, TRANSITIONS, E, features_sql
from fleetsight.registry.base import query, r6
from fleetsight.registry.features import DENSE_SQL, SECRET
from fleetsight.session import checkpoint_dir
from fleetsight.sources.lines import parse_kernel_events, parse_metric_lines
from fleetsight.sources.tables import read_state
from fleetsight.streaming.features import complete_dense, in_open_windows
from fleetsight.streaming.features import stream_event_features as features_of_stream
from fleetsight.streaming.features import stream_kind_counts as kinds_of_stream
from fleetsight.streaming.run import run_bounded, stream_to_table
from fleetsight.streaming.stateful import DENSE_TABLES, ROCKSDB, STATE_STORE_CONF, dense_step, stream_sequence_scores
from fleetsight.streaming.steps import stream_steps
from fleetsight.streaming.trust import stream_detect_v1
from fleetsight.streaming.trust import stream_trust as trust_of_stream


@query(
    f"""WITH {E} SELECT event_id, event_id % 50 <> 0 AND event_id % 23 <> 4 AS verified
FROM e WHERE event_id % 31 <> 2"""
)
def verify_signatures(spark, sf_dir):
    lines = parse_metric_lines(ad.metric_lines(ad.events(spark, sf_dir), SECRET))
    return lines.select("event_id", verify_signature(F.col("raw"), SECRET).alias("verified"))


_DETECT_SQL = f"""WITH {E}, good AS (
  SELECT *, event_id % 50 = 0 OR event_id % 23 = 4 AS tampered,
         value / 1000 - 0.2 <= -0.17 AS low
  FROM e WHERE event_id % 31 <> 2 AND event_id % 13 <> 1),
used AS (SELECT * FROM good WHERE tampered OR event_id % 41 <> 5),
steps AS (SELECT *, list(CASE WHEN tampered THEN -1000.0::DOUBLE WHEN low THEN -15.0 ELSE 2.0 END)
    OVER w AS ds, bool_or(tampered) OVER w AS seen FROM used
  WINDOW w AS (PARTITION BY node ORDER BY us)),
s AS (SELECT *, list_reduce(ds, lambda a, x: least(100.0, greatest(0.0, a + x)), 100.0::DOUBLE)
  AS score FROM steps),
n AS (SELECT *, CASE WHEN seen THEN 'Compromised' WHEN score < 30 THEN 'Banned'
  WHEN score < 75 THEN 'Probation' ELSE 'Healthy' END AS status FROM s),
p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY node ORDER BY us), 'Healthy') AS old FROM n)
SELECT event_id, node, CASE WHEN tampered THEN 'Tampered' WHEN low THEN 'Anomaly' ELSE 'Normal' END
    AS raw_status, score, status,
  CASE WHEN tampered THEN 'BAN' WHEN status = 'Compromised' THEN NULL
    WHEN status = 'Banned' AND old <> 'Banned' THEN 'BAN'
    WHEN status = 'Probation' AND old = 'Healthy' THEN 'TAINT'
    WHEN status = 'Healthy' AND old = 'Probation' THEN 'UNTAINT'
    WHEN status = 'Healthy' AND old = 'Banned' THEN 'UNCORDON+UNTAINT' END AS action
FROM p"""


@query(_DETECT_SQL)
def detect_trust_v1(spark, sf_dir):
    lines = ad.metric_lines(ad.events(spark, sf_dir), SECRET)
    trace = detect_v1(
        lines,
        SECRET,
        scorer=lambda: F.col("cpu") / 1000 - 0.2,
        threshold=-0.17,
        now=F.col("arrival"),
    )
    return trace.select("event_id", "node", "raw_status", "score", "status", "action")


@query()
def detect_trust_v2(spark, sf_dir):
    """Train, score and keep trust on the metric rows of the events table."""
    metrics = ad.metrics_v2(ad.events(spark, sf_dir))
    trained = train_v2(metrics)
    scored = score_sequences(metrics, trained.scaler, trained.model, trained.threshold)
    return detect_v2(scored.drop("seq"), plan_from=metrics)


# ----------------------------------------------------------------------------------- models


@query()
def iforest_scores(spark, sf_dir):
    scaled = standard_scale(ad.forest_items(spark, sf_dir), ad.FOREST_FEATURES)
    _, scored = fit_and_score_iforest(scaled, ad.FOREST_FEATURES, ad.FOREST_ID, ad.FOREST_ID)
    return scored.select(*ad.FOREST_ID, r6("score"))


@query()
def train_record_detector(spark, sf_dir):
    model = train_v1(ad.forest_items(spark, sf_dir), ad.FOREST_ID, ad.FOREST_FEATURES)
    return model.summary.select(*[r6(c) for c in model.summary.columns])


_CUTS = (25.0, 40000.0, 0.05)


def _given_forest() -> Forest:
    """Two small trees, written down."""
    q, price, discount = _CUTS
    nodes = [
        (0, 0, 0, q, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 1.0), (0, 2, 1, price, 3, 4, 0.0),
        (0, 3, -1, 0.0, 3, 3, 2.0), (0, 4, -1, 0.0, 4, 4, 2.5),
        (1, 0, 2, discount, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 1.5), (1, 2, -1, 0.0, 2, 2, 3.0),
    ]
    cols = ["tree", "node", "feature", "cut", "left", "right", "depth"]
    return Forest(pd.DataFrame(nodes, columns=cols), ad.FOREST_FEATURES, 4, -0.5)


_GIVEN_FOREST = f"""given AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    -pow(2::DOUBLE, -((CASE WHEN l_quantity < {_CUTS[0]} THEN 1.0::DOUBLE
      WHEN l_extendedprice < {_CUTS[1]} THEN 2.0 ELSE 2.5 END
      + CASE WHEN l_discount < {_CUTS[2]} THEN 1.5::DOUBLE ELSE 3.0 END) / 2) / {average_path(4)!r}::DOUBLE)
      + 0.5::DOUBLE AS score
  FROM lineitem)"""


@query(f"""WITH {_GIVEN_FOREST} SELECT * REPLACE (round(score, 6) AS score) FROM given""")
def iforest_given_scores(spark, sf_dir):
    """Scoring with a given forest is plain arithmetic."""
    scored = score_iforest(ad.forest_items(spark, sf_dir), _given_forest())
    return scored.select(*ad.FOREST_ID, r6("score"))


@query(f"""WITH {_GIVEN_FOREST} SELECT * REPLACE (round(score, 6) AS score) FROM given""")
def iforest_native_scores(spark, sf_dir):
    """The same scores without Python workers."""
    scored = score_iforest(ad.forest_items(spark, sf_dir), _given_forest(), native=True)
    return scored.select(*ad.FOREST_ID, r6("score"))


@query(
    f"""WITH {_GIVEN_FOREST} SELECT count(*) AS total_rows,
  count(*) FILTER (score <= -0.01) AS anomalies FROM given"""
)
def iforest_given_totals(spark, sf_dir):
    """Verdicts and totals of a report (Q7) from forest scores."""
    items = ad.forest_items(spark, sf_dir)
    scored = classify(score_iforest(items, _given_forest()), "score", -0.01, "low")
    totals = detection_totals(scored)
    return totals.select(F.col(totals.columns[0]).alias("total_rows"), F.col(totals.columns[1]).alias("anomalies"))


def _sequences(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    points = ev.select("node", "ts", "value", F.col("k").cast("double").alias("k"))
    return make_sequences(points, ["value", "k"], 10, by=["node"])


@query()
def reconstruction_scores(spark, sf_dir):
    seqs = _sequences(spark, sf_dir)
    with kept(seqs) as training:
        model = rec.fit_reconstruction(training)
        threshold = rec.calibrate(training, model).first()["threshold"]
    scored = rec.score_reconstruction(seqs, model, threshold)
    return scored.select("node", F.unix_micros("ts").alias("ts"), r6("loss"), "status")


# The first eight of twenty numbers pass; each other one is replaced by the mean 0.5.
_KEPT = 8


_GIVEN_LOSS = f"""WITH {E}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY node) AS n,
    list(value) OVER ten AS v, list(k::DOUBLE) OVER ten AS ks, first_value(us) OVER ten AS first_us FROM e
  WINDOW w AS (PARTITION BY node ORDER BY us),
    ten AS (PARTITION BY node ORDER BY us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
q AS (SELECT node, first_us, list_transform(range(20), lambda j:
    CASE WHEN j % 2 = 0 THEN v[j // 2 + 1] ELSE ks[j // 2 + 1] END) AS x FROM r WHERE i >= 10 AND i < n)
SELECT node, first_us AS ts, round(list_sum(list_transform(range({_KEPT}, 20), lambda j: abs(x[j + 1] - 0.5))) / 20, 6) AS loss,
  CASE WHEN list_sum(list_transform(range({_KEPT}, 20), lambda j: abs(x[j + 1] - 0.5))) / 20 > 40
    THEN 'Anomaly' ELSE 'Normal' END AS status FROM q"""


@query(_GIVEN_LOSS)
def reconstruction_given_scores(spark, sf_dir):
    """Scoring with a given bottleneck is plain arithmetic."""
    model = rec.Reconstruction(np.full(20, 0.5), np.eye(20)[:, :_KEPT])
    scored = rec.score_reconstruction(_sequences(spark, sf_dir), model, 40.0)
    return scored.select("node", F.unix_micros("ts").alias("ts"), r6("loss"), "status")


@query(_GIVEN_LOSS)
def reconstruction_native_scores(spark, sf_dir):
    """The same losses without Python workers."""
    model = rec.Reconstruction(np.full(20, 0.5), np.eye(20)[:, :_KEPT])
    scored = rec.score_reconstruction(_sequences(spark, sf_dir), model, 40.0, native=True)
    return scored.select("node", F.unix_micros("ts").alias("ts"), r6("loss"), "status")


@query()
def augment_noise(spark, sf_dir):
    noisy = rec.augment_noise(_sequences(spark, sf_dir), ["node", "ts"])
    total = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return noisy.select("node", F.unix_micros("ts").alias("ts"), r6(total, "total"))


# ---------------------------------------------------------------------------------- streams


def _workspace(spark) -> str:
    """Fresh folder under the cluster's checkpoint folder. A local one only where that is unset and
    the executors live in this process: elsewhere each would write to a disk of its own."""
    base = None
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="fleetsight-")
    return f"{checkpoint_dir(spark, base)}/run-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = ad.load(spark, sf_dir, "events").schema
    # a glob, since a stream path may not be a plain file; it matches a folder of files as well
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return ad.shape_events(raw)


def _run_to_frame(spark, stream):
    work = _workspace(spark)
    run_bounded(stream_to_table(stream, f"{work}/out", f"{work}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


@query(
    f"""WITH {KERNEL}, {features_sql('hour')}
SELECT node, epoch_us(w) AS window_start, {COUNT_NAMES} FROM features"""
)
def stream_event_features(spark, sf_dir):
    kernel = parse_kernel_events(ad.kernel_lines(_event_stream(spark, sf_dir)))
    closed = _run_to_frame(spark, features_of_stream(kernel, "1 hour"))
    stored = parse_kernel_events(ad.kernel_lines(ad.events(spark, sf_dir)))
    out = closed.unionByName(features_of_stream(in_open_windows(stored, "1 hour"), "1 hour"))
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query(
    f"""WITH {KERNEL}, kinds AS (SELECT node, date_trunc('hour', ts) AS w, kind, count(*) AS n
  FROM parsed WHERE event_class IS NOT NULL GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start, kind, n FROM kinds"""
)
def stream_kind_counts(spark, sf_dir):
    kernel = parse_kernel_events(ad.kernel_lines(_event_stream(spark, sf_dir)))
    closed = _run_to_frame(spark, kinds_of_stream(kernel, "1 hour"))
    stored = parse_kernel_events(ad.kernel_lines(ad.events(spark, sf_dir)))
    out = closed.unionByName(kinds_of_stream(in_open_windows(stored, "1 hour"), "1 hour"))
    return out.withColumn("window_start", F.unix_micros("window_start"))


def _trust_run(spark, sf_dir):
    work = _workspace(spark)
    records = ad.records(_event_stream(spark, sf_dir))
    run_bounded(
        trust_of_stream(records, work, f"{work}/checkpoint", order=("ts", "event_id"))
    )
    return work


@query(f"WITH {TRANSITIONS} SELECT node, event_id, score, status, action FROM acted")
def stream_trust(spark, sf_dir):
    trace = spark.read.parquet(f"{_trust_run(spark, sf_dir)}/trace")
    return trace.select("node", "event_id", "score", "status", "action")


@query(
    f"""WITH {LATEST} SELECT node, us / 1000000 AS last_seen, cpu, score, status, raw_status
FROM latest"""
)
def stream_state(spark, sf_dir):
    return read_state(spark, f"{_trust_run(spark, sf_dir)}/state")


def _with_rocksdb(spark, run):
    before = spark.conf.get(STATE_STORE_CONF, None)
    spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE_CONF)
        else:
            spark.conf.set(STATE_STORE_CONF, before)


@query(_DETECT_SQL)
def stream_detect(spark, sf_dir):
    work = _workspace(spark)
    lines = ad.metric_lines(_event_stream(spark, sf_dir), SECRET)
    run_bounded(
        stream_detect_v1(
            lines,
            SECRET,
            lambda: F.col("cpu") / 1000 - 0.2,
            work,
            f"{work}/checkpoint",
            threshold=-0.17,
            now=F.col("arrival"),
        )
    )
    trace = spark.read.parquet(f"{work}/trace")
    return trace.select("event_id", "node", "raw_status", "score", "status", "action")


@query()
def stream_sequence_losses(spark, sf_dir):
    model = rec.fit_reconstruction(_sequences(spark, sf_dir))
    points = _event_stream(spark, sf_dir).select("node", "ts", "value", "k")
    scored = stream_sequence_scores(points, model, ["value", "k"])
    out = _with_rocksdb(spark, lambda: _run_to_frame(spark, scored))
    return out.select("node", F.unix_micros("ts").alias("ts"), r6("loss"))


@query(
    f"""WITH {KERNEL}, {features_sql('day')},
last_window AS (SELECT max(w) AS last_w FROM features), {DENSE_SQL}
SELECT node, epoch_us(w) AS window_start, {COUNT_NAMES} FROM dense"""
)
def stream_densify(spark, sf_dir):
    kernel = parse_kernel_events(ad.kernel_lines(_event_stream(spark, sf_dir)))
    work = _workspace(spark)
    features = features_of_stream(kernel, "1 day")
    run = lambda: run_bounded(stream_steps(features, dense_step(86_400), DENSE_TABLES, work, f"{work}/checkpoint"))
    _with_rocksdb(spark, run)
    closed = spark.read.parquet(f"{work}/out").drop("batch")
    stored = parse_kernel_events(ad.kernel_lines(ad.events(spark, sf_dir)))
    still_open = features_of_stream(in_open_windows(stored, "1 day"), "1 day")
    out = complete_dense(closed, still_open, "1 day")
    return out.withColumn("window_start", F.unix_micros("window_start"))
