"""Collection, feature-dataset and labeling jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.operators.events import (
    WINDOW,
    assemble_features,
    densify,
    event_summary,
)
from fleetsight.operators.labeling import label_dataset, label_totals
from fleetsight.operators.predicates import project_defaults
from fleetsight.operators.vectors import align_long
from fleetsight.plans.kept import settled
from fleetsight.schemas import EVENT_COUNTS
from fleetsight.sinks.tables import CSV_OPTIONS, append_table, write_labeled, write_table
from fleetsight.sources.lines import parse_metric_lines
from fleetsight.sources.payloads import parse_instant_vector


def feature_dataset(
    events: DataFrame, metrics: DataFrame, window: str = WINDOW, ts: str = "ts"
) -> DataFrame:
    """Kernel events and metric samples -> one row per known node and window.

    A node seen in events keeps emitting rows, zero where it was silent, up to the last window
    of either input. ``metrics`` is long (node, window_start, metric, value). The events are
    parsed and counted once; the grid works on the far smaller result.
    """
    features = settled(event_summary(events, window, ts))
    ends = features.select("window_start").unionByName(metrics.select("window_start"))
    last = ends.agg(F.max("window_start").alias("last_window"))
    return assemble_features(metrics, densify(features, window, fill=EVENT_COUNTS, end=last))


def build_feature_dataset(events: DataFrame, metrics: DataFrame, path: str, **kw) -> None:
    write_table(feature_dataset(events, metrics, **kw), path)


def build_labeled_dataset(
    features: DataFrame, windows: DataFrame, path: str, fmt: str = "parquet"
) -> DataFrame:
    """Label and save; returns the totals of the saved table."""
    labeled = label_dataset(features, windows)
    if fmt == "parquet":
        write_labeled(labeled, path)
    else:
        write_table(labeled, path, fmt=fmt)
    reader = features.sparkSession.read
    if fmt == "csv":  # the label is the second column of the file; header names pick it
        return label_totals(reader.options(**CSV_OPTIONS).csv(path).select("label"))
    return label_totals(reader.schema(labeled.schema).parquet(path))


def metric_rows_v1(lines: DataFrame) -> DataFrame:
    """Metric lines -> table rows: expected columns only, absent ones 0, signature dropped."""
    cols = ("node", "timestamp", "cpu", "mem", "net_out", "net_in", "latency")
    return project_defaults(parse_metric_lines(lines), cols, 0)


def collect_v1(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    append_table(metric_rows_v1(lines), path, fmt)


def metric_rows_v2(payloads: DataFrame, tick: str = "timestamp") -> DataFrame:
    """Instant-vector payloads (tick, metric, payload) -> aligned rows per tick and instance."""
    values = parse_instant_vector(payloads, "payload", "unknown", by=[tick, "metric"])
    return align_long(values, keys=[tick, "instance"])


def collect_v2(payloads: DataFrame, path: str, fmt: str = "parquet") -> None:
    append_table(metric_rows_v2(payloads), path, fmt)
