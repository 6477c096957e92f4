"""Detection and trust jobs (record detector v1, sequence detector v2) and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.signing import verify_signature
from fleetsight.operators.forest import Forest, score_iforest
from fleetsight.operators.predicates import classify, drop_stale, exclude_nodes
from fleetsight.operators.reconstruct import Reconstruction, score_reconstruction
from fleetsight.operators.scaling import detection_totals, minmax_scale
from fleetsight.operators.timeseries import (
    align_last_n,
    make_sequences,
    series_for_plot,
    with_params,
)
from fleetsight.operators.trust import (
    V1,
    V2,
    TrustPolicy,
    cordon_trace,
    latest_state,
    status_transitions,
    trust_scores,
)
from fleetsight.plans.kept import settled
from fleetsight.schemas import FEATURES_V1, FEATURES_V2
from fleetsight.sinks.tables import detection_report
from fleetsight.sources.lines import parse_metric_lines

# Score limits of the record detector, live and for batch reports.
LIVE_THRESHOLD = -0.045
REPORT_THRESHOLD = -0.085

Scorer = Callable[[], Column]


def forest_scorer(forest: Forest) -> Scorer:
    return forest.score_column


def fresh_records(
    lines: DataFrame, max_age_s: float = 5.0, now: Column | None = None
) -> DataFrame:
    """Parsed records that are recent enough and name a node."""
    return drop_stale(parse_metric_lines(lines), max_age_s, now).where(F.col("node").isNotNull())


def verify_and_score(
    lines: DataFrame,
    secret: str,
    scorer: Scorer,
    threshold: float = LIVE_THRESHOLD,
    feats: Sequence[str] = FEATURES_V1,
    max_age_s: float = 5.0,
    now: Column | None = None,
) -> DataFrame:
    """Raw lines -> verified, scored records. Row-local, hence the same in batch and stream.

    Order of checks: parse, staleness, node, signature, features, score. A tampered record is
    kept without a score; a good record that lacks a feature is dropped. Rows that are no longer
    needed go before the Python UDFs, not after.
    """
    fresh = fresh_records(lines, max_age_s, now)
    # As the element of an array: the filter below would otherwise run the Python part once more.
    tampered = F.explode(F.array(~verify_signature(F.col("raw"), secret)))
    checked = fresh.withColumn("tampered", tampered)
    complete = F.lit(True)
    for f in feats:
        complete = complete & F.col(f).isNotNull()
    usable = checked.where(F.col("tampered") | complete).drop("raw", "signature")
    scored = usable.withColumn("ml_score", scorer())
    verdict = classify(scored, "ml_score", threshold, "low", out="raw_status")
    return verdict.withColumn(
        "raw_status", F.when(F.col("tampered"), "Tampered").otherwise(F.col("raw_status"))
    ).withColumn("is_anomaly", F.col("raw_status") == "Anomaly")


def trust_trace_v1(
    scored: DataFrame,
    policy: TrustPolicy = V1,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("timestamp",),
    rows_per_chunk: int | None = None,
    plan_from: DataFrame | None = None,
) -> DataFrame:
    """Scores, statuses and actions per record."""
    trusted = trust_scores(
        scored,
        policy,
        key=key,
        order=order,
        tampered="tampered",
        rows_per_chunk=rows_per_chunk,
        plan_from=plan_from,
    )
    return status_transitions(trusted, "tampered")


def current_state(trace: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Snapshot rows (node, last_seen, cpu, score, status, raw_status)."""
    latest = latest_state(
        trace, order=order, cols=["timestamp", "cpu", "score", "status", "raw_status"]
    )
    return latest.withColumnRenamed("timestamp", "last_seen")


def detect_v1(
    lines: DataFrame,
    secret: str,
    scorer: Scorer,
    threshold: float = LIVE_THRESHOLD,
    order: Sequence[str] = ("timestamp",),
    **kw,
) -> DataFrame:
    """Signed metric lines -> per-record trust trace with actions.

    Lines are parsed, checked and scored once: the records are stored (``spark.checkpoint.dir``), and
    the cuts of busy nodes, the carry over their chunks and the trace read the columns they need.
    """
    scored = settled(verify_and_score(lines, secret, scorer, threshold, **kw))
    return trust_trace_v1(scored, order=order)


def score_sequences(
    metrics: DataFrame,
    scaler: DataFrame,
    model: Reconstruction,
    threshold: DataFrame,
    key: str = "instance",
    ts: str = "timestamp",
    length: int = 10,
) -> DataFrame:
    """Metric rows -> one verdict per node and trailing sequence (all sequences kept)."""
    nodes = exclude_nodes(metrics, node=key).dropna(subset=list(FEATURES_V2))
    scaled = minmax_scale(nodes, FEATURES_V2, scaler)
    seqs = make_sequences(scaled, FEATURES_V2, length, drop_last=False, by=[key], order=[ts])
    limited = with_params(seqs, threshold.select("threshold"))
    return score_reconstruction(limited, model, F.col("threshold"))


def scaled_samples(
    samples: DataFrame, scaler: DataFrame, metrics: Sequence[str] = FEATURES_V2
) -> DataFrame:
    """Metric samples (metric, value) scaled by one row of ``<metric>_min`` and ``<metric>_max``, in
    batch and in streams."""
    known = with_params(samples, scaler)
    scaled = F.lit(None).cast("double")
    for m in metrics:
        spread = F.col(f"{m}_max") - F.col(f"{m}_min")
        unit = (F.col("value") - F.col(f"{m}_min")) / F.when(spread == 0, 1.0).otherwise(spread)
        scaled = F.when(F.col("metric") == m, unit).otherwise(scaled)
    return known.withColumn("value", scaled).drop(*scaler.columns)


def latest_sequence_scores(
    series: DataFrame,
    scaler: DataFrame,
    model: Reconstruction,
    threshold: DataFrame,
    key: str = "node",
    length: int = 10,
) -> DataFrame:
    """Metric samples (node, metric, ts, value), e.g. parsed range matrices, -> one verdict per
    node on its newest ``length`` points of every metric. Nodes with too few points are left out.
    """
    samples = scaled_samples(exclude_nodes(series, node=key), scaler)
    seqs = align_last_n(samples, length, key=[key], metrics=FEATURES_V2)
    limited = with_params(seqs, threshold.select("threshold"))
    return score_reconstruction(limited, model, F.col("threshold"))


def detect_v2(
    scored: DataFrame,
    policy: TrustPolicy = V2,
    key: str = "instance",
    ts: str = "timestamp",
    auto_remediate: bool | str = True,
    plan_from: DataFrame | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Sequence verdicts -> trust score, cordon flag and cordon actions. ``plan_from``: the
    metric rows the verdicts came from, which hold every (node, time) of them. ``ties``: columns
    that order verdicts of one node and time."""
    flagged = scored.withColumn("is_anomaly", F.col("status") == "Anomaly")
    return cordon_trace(
        flagged,
        policy,
        key=[key],
        order=[ts, *ties],
        plan_from=plan_from,
        auto_remediate=auto_remediate,
    )


def batch_report(
    metrics: DataFrame,
    forest: Forest,
    threshold: float = REPORT_THRESHOLD,
    order: Sequence[str] = ("pos",),
) -> tuple[DataFrame, DataFrame]:
    """(report lines, totals) of a scored metrics table."""
    scored = classify(score_iforest(metrics, forest), "score", threshold, "low")
    return detection_report(scored, order), detection_totals(scored)


def plot_series(metrics: DataFrame, forest: Forest, order: Sequence[str], **kw) -> DataFrame:
    """Chart rows of cpu and anomaly score per node."""
    return series_for_plot(score_iforest(metrics, forest), ("cpu", "score"), order=order, **kw)
