"""Queries in SQL text over the registered functions."""

from __future__ import annotations

import numpy as np

from fleetsight import adapters as ad
from fleetsight.functions.sql import register_functions
from fleetsight.operators import reconstruct as rec
from fleetsight.registry.base import ORACLES, TRANSITIONS, query
from fleetsight.registry.features import SECRET
from fleetsight.registry.models import _given_forest, _sequences
from fleetsight.sources.lines import parse_metric_lines


@query(ORACLES["verify_signatures"])
def sql_verify_line(spark, sf_dir):
    register_functions(spark, secret=SECRET)
    lines = parse_metric_lines(ad.metric_lines(ad.events(spark, sf_dir), SECRET))
    return spark.sql("SELECT event_id, verify_line(raw) AS verified FROM {lines}", lines=lines)


@query(ORACLES["iforest_given_scores"])
def sql_record_score(spark, sf_dir):
    register_functions(spark, forest=_given_forest())
    features = ", ".join(f"CAST({f} AS DOUBLE)" for f in ad.FOREST_FEATURES)
    items = ad.forest_items(spark, sf_dir)
    return spark.sql(f"SELECT {', '.join(ad.FOREST_ID)}, round(record_score({features}), 6) AS score FROM {{items}}", items=items)


@query(ORACLES["reconstruction_given_scores"])
def sql_sequence_loss(spark, sf_dir):
    register_functions(spark, model=rec.Reconstruction(np.full(20, 0.5), np.eye(20)[:, :8]))
    return spark.sql(
        """SELECT node, unix_micros(ts) AS ts, round(loss, 6) AS loss, CASE WHEN loss > 40 THEN 'Anomaly' ELSE 'Normal' END AS status
        FROM (SELECT node, ts, sequence_loss(flatten(seq)) AS loss FROM {seqs})""",
        seqs=_sequences(spark, sf_dir),
    )


@query(f"WITH {TRANSITIONS} SELECT node, event_id, score, status FROM acted")
def sql_trust_fold(spark, sf_dir):
    register_functions(spark)
    records = ad.records(ad.events(spark, sf_dir)).select("node", "ts", "event_id", "is_anomaly", "tampered")
    return spark.sql(
        """SELECT node, event_id, score, CASE WHEN compromised THEN 'Compromised' WHEN score < 30 THEN 'Banned'
          WHEN score < 75 THEN 'Probation' ELSE 'Healthy' END AS status
        FROM trust_fold(TABLE(SELECT * FROM {records}) PARTITION BY node ORDER BY (ts, event_id), 15.0D, 2.0D)""",
        records=records,
    )
