"""Queries: tables and parameters that are written and read back, and jobs on what was read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight import schemas
from fleetsight.jobs.detect import scaled_samples
from fleetsight.jobs.training import validate_v2
from fleetsight.operators import reconstruct as rec
from fleetsight.operators.scaling import fit_minmax
from fleetsight.operators.timeseries import make_sequences
from fleetsight.registry.base import TRANSITIONS, E, micros, query, r6
from fleetsight.registry.models import _event_stream, _run_to_frame, _with_rocksdb, _workspace
from fleetsight.registry.series import _LOW_SQL, _classified
from fleetsight.sinks.tables import append_table, save_params, write_labeled, write_report, write_table
from fleetsight.sources.tables import load_params, load_threshold, read_metrics_csv
from fleetsight.streaming.stateful import stream_trust_keyed as keyed_trust

_V2_SQL = """SELECT epoch_us(ts) AS timestamp, node AS instance, value AS cpu, k::DOUBLE AS mem,
  value * CASE WHEN event_type = 'error' THEN 4 ELSE 1 END AS net_in, (event_id % 100)::DOUBLE AS net_out FROM e"""


@query(f"WITH {E} {_V2_SQL}")
def csv_metrics(spark, sf_dir):
    """A metrics table written as CSV in a fixed column order and read back by its schema."""
    path = f"{_workspace(spark)}/metrics"
    columns = ["timestamp", "instance", "cpu", "mem", "net_in", "net_out"]
    for _ in range(2):  # the second write replaces the first
        write_table(ad.metrics_v2(ad.events(spark, sf_dir)), path, columns, "csv")
    back = read_metrics_csv(spark, path, schemas.METRICS_V2)
    return back.select(micros("timestamp"), *columns[1:])


@query(f"WITH {E} {_V2_SQL} WHERE event_id % 3 <> 2")
def append_metrics(spark, sf_dir):
    """Two collections appended to one dataset; every CSV part has its header, read once a file."""
    path = f"{_workspace(spark)}/metrics"
    for rest in (0, 1):
        some = ad.events(spark, sf_dir).where(F.col("event_id") % 3 == rest)
        append_table(ad.metrics_v2(some), path, "csv")
    back = read_metrics_csv(spark, path, schemas.METRICS_V2)
    return back.select(micros("timestamp"), "instance", "cpu", "mem", "net_in", "net_out")


@query(f"WITH {E} SELECT event_id, node, value, event_type AS label FROM e WHERE event_type IN ('error', 'view')")
def labeled_partitions(spark, sf_dir):
    """A dataset in folders by label, of which two are read."""
    path = f"{_workspace(spark)}/labeled"
    rows = ad.events(spark, sf_dir).select("event_id", "node", "value", F.col("event_type").alias("label"))
    write_labeled(rows, path)
    return spark.read.parquet(path).where(F.col("label").isin("error", "view")).select("event_id", "node", "value", "label")


@query(
    f"""WITH {E}, s AS (SELECT min(value) AS lo, max(value) AS hi, min(k)::DOUBLE AS klo, max(k)::DOUBLE AS khi FROM e)
SELECT event_id, 'cpu' AS metric, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value, 0.5::DOUBLE AS threshold FROM e, s
UNION ALL SELECT event_id, 'mem', round((k - klo) / CASE WHEN khi = klo THEN 1 ELSE khi - klo END, 6), 0.5::DOUBLE FROM e, s"""
)
def saved_parameters(spark, sf_dir):
    """A fitted scaler saved, loaded and applied; the threshold that nobody saved takes its default."""
    path = _workspace(spark)
    ev = ad.events(spark, sf_dir).withColumns({"cpu": F.col("value"), "mem": F.col("k").cast("double")})
    save_params(fit_minmax(ev, ["cpu", "mem"]), f"{path}/scaler")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("cpu", "mem")])
    samples = ev.select("event_id", F.inline(pairs))
    scaled = scaled_samples(samples, load_params(spark, f"{path}/scaler"), ("cpu", "mem"))
    threshold = load_threshold(spark, f"{path}/threshold")
    return scaled.crossJoin(F.broadcast(threshold)).select("event_id", "metric", r6("value"), "threshold")


@query(
    f"""WITH {_LOW_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (status = 'Anomaly') AS a FROM v),
l AS (SELECT 'Node            CPU    Score    Status' || chr(10) || repeat('-', 40) AS line
UNION ALL SELECT printf('%-15s %-6s %-8s %s', node, printf('%.1f', value), printf('%.3f', k / 7), status)
  || CASE WHEN status = 'Anomaly' THEN ' <--- DETECTED' ELSE '' END FROM v
UNION ALL SELECT repeat('-', 40) || chr(10) || 'Total Rows: ' || n || chr(10) || 'Anomalies Detected: ' || a FROM c)
SELECT unnest(string_split(line, chr(10))) AS line FROM l"""
)
def written_report(spark, sf_dir):
    """The report as text files, in order."""
    path = f"{_workspace(spark)}/report"
    rows = _classified(spark, sf_dir).withColumns({"cpu": F.col("value"), "score": F.col("k") / 7})
    write_report(rows, path, order=("event_id",))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER w AS i, list(value) OVER ten AS v, list(k::DOUBLE) OVER ten AS ks,
    first_value(event_type) OVER ten AS label FROM e
  WINDOW w AS (PARTITION BY node ORDER BY us), ten AS (PARTITION BY node ORDER BY us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
q AS (SELECT label, (list_sum(list_transform(v[5:10], lambda x: abs(x - 0.5))) + list_sum(list_transform(ks[5:10], lambda x: abs(x - 0.5)))) / 20 > 40 AS bad
  FROM r WHERE i >= 10)
SELECT label, count(*) AS n, count(*) FILTER (label = 'view' AND NOT bad) AS correct_normal, count(*) FILTER (label = 'view' AND bad) AS false_positive,
  count(*) FILTER (label <> 'view' AND bad) AS detected, count(*) FILTER (label <> 'view' AND NOT bad) AS missed FROM q GROUP BY label"""
)
def validate_sequences(spark, sf_dir):
    """The sequence detector held against the label of each sequence's first event."""
    ev = ad.events(spark, sf_dir)
    points = ev.select("node", "ts", "value", F.col("k").cast("double").alias("k"))
    seqs = make_sequences(points, ["value", "k"], 10, drop_last=False, by=["node"])
    labels = ev.select(F.col("node").alias("n"), F.col("ts").alias("t"), F.col("event_type").alias("label"))
    labeled = seqs.join(labels, (F.col("node") == F.col("n")) & (F.col("ts") == F.col("t")))
    model = rec.Reconstruction(np.full(20, 0.5), np.eye(20)[:, :8])
    return validate_v2(labeled.withColumn("label", F.when(F.col("label") == "view", "normal").otherwise(F.col("label"))), model, 40.0).withColumn(
        "label", F.when(F.col("label") == "normal", "view").otherwise(F.col("label"))
    )


@query(f"WITH {TRANSITIONS} SELECT node, event_id, score, status, action FROM acted")
def stream_trust_keyed(spark, sf_dir):
    """Trust kept in keyed state, one row per node."""
    records = ad.records(_event_stream(spark, sf_dir)).select("node", "ts", "event_id", "is_anomaly", "tampered")
    trace = _with_rocksdb(spark, lambda: _run_to_frame(spark, keyed_trust(records, order=("ts", "event_id"))))
    return trace.select("node", "event_id", "score", "status", "action")
