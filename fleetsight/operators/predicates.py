"""Projections, filters and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_defaults(df: DataFrame, cols: Sequence[str], default=0) -> DataFrame:
    """Keep exactly ``cols``; a missing column or null value becomes ``default``."""
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(default).cast(df.schema[c].dataType)).alias(c)
            if c in df.columns
            else F.lit(default).alias(c)
            for c in cols
        ]
    )


def select_features(
    df: DataFrame, feats: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Feature columns in fixed order after ``keep``; rows lacking a feature are dropped."""
    return df.select(*keep, *feats).dropna(subset=list(feats))


def _age(now: Column | None, ts: str) -> Column:
    if now is None:
        now = F.unix_micros(F.current_timestamp()) / 1_000_000
    return now - F.coalesce(F.col(ts), F.lit(0.0))


def drop_stale(
    df: DataFrame,
    max_age_s: float = 5.0,
    now: Column | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """Drop records older than ``max_age_s``; no timestamp counts as epoch 0.

    ``now`` is an arrival-time column in epoch seconds (wall clock when left out, as in streams).
    Unlike a watermark this compares each record with the clock, not with the newest event.
    """
    return df.where(_age(now, ts) <= max_age_s)


def stale_records(
    df: DataFrame,
    max_age_s: float = 5.0,
    now: Column | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """What ``drop_stale`` drops, for a side table of late records."""
    return df.where(_age(now, ts) > max_age_s)


def exclude_nodes(df: DataFrame, substr: str = "control-plane", node: str = "node") -> DataFrame:
    return df.where(~F.col(node).contains(substr))


def select_series(
    df: DataFrame, metric: str, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Samples of one metric whose label map holds all the given values."""
    wanted = [F.col("metric") == metric]
    wanted += [F.col("labels")[k] == v for k, v in (labels or {}).items()]
    return df.where(reduce(lambda a, b: a & b, wanted))


def classify(
    df: DataFrame,
    score: str,
    threshold: Column | float,
    direction: str = "low",
    out: str = "status",
) -> DataFrame:
    """Normal/Anomaly verdicts.

    ``low``: normal only when score > threshold (a tie or NaN is an anomaly).
    ``high``: anomaly only when score > threshold (a tie or NaN is normal).
    Spark orders NaN above all numbers, hence the guard.
    """
    above = (F.col(score) > threshold) & ~F.isnan(score)
    above = F.coalesce(above, F.lit(False))
    if direction == "low":
        verdict = F.when(above, "Normal").otherwise("Anomaly")
    elif direction == "high":
        verdict = F.when(above, "Anomaly").otherwise("Normal")
    else:
        raise ValueError(f"unknown direction {direction!r}")
    return df.withColumn(out, verdict)


def bad_nodes(state: DataFrame, include_compromised: bool = False) -> DataFrame:
    """Nodes that are banned or on probation (compromised ones only on request)."""
    bad = ["Banned", "Probation"] + (["Compromised"] if include_compromised else [])
    return state.where(F.col("status").isin(*bad))
