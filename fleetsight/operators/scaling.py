"""Scaler fits, threshold calibration and verdict evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.operators.timeseries import with_params
from fleetsight.plans.quantiles import exact_quantile

SUGGESTED_MARGIN = 0.05
CONTAMINATION = 0.01


def fit_minmax(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row ``{f}_min, {f}_max`` per feature, one pass."""
    return df.agg(
        *[a for f in feats for a in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    )


def fit_standard(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row ``{f}_mean, {f}_std`` (population) per feature, one pass."""
    return df.agg(
        *[
            a
            for f in feats
            for a in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))
        ]
    )


def fitted(params: DataFrame) -> DataFrame:
    """The few rows of ``params`` (one per fit or key) computed now, so that no later pass fits
    again."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)


def standard_scale(
    df: DataFrame, feats: Sequence[str], params: DataFrame | None = None
) -> DataFrame:
    """(x - mean) / std; a constant feature is divided by 1. Without ``params`` it fits once, now."""
    params = params if params is not None else fitted(fit_standard(df, feats))
    scaled = {
        f: (F.col(f) - F.col(f"{f}_mean"))
        / F.when(F.col(f"{f}_std") == 0, 1.0).otherwise(F.col(f"{f}_std"))
        for f in feats
    }
    return with_params(df, params).withColumns(scaled).drop(*params.columns)


def minmax_scale(
    df: DataFrame, feats: Sequence[str], params: DataFrame | None = None
) -> DataFrame:
    """(x - min) / (max - min), not clipped; a constant feature becomes 0. Without ``params`` it fits
    once, now."""
    params = params if params is not None else fitted(fit_minmax(df, feats))

    def scaled(f: str) -> Column:
        spread = F.col(f"{f}_max") - F.col(f"{f}_min")
        return (F.col(f) - F.col(f"{f}_min")) / F.when(spread == 0, 1.0).otherwise(spread)

    return (
        with_params(df, params)
        .withColumns({f: scaled(f) for f in feats})
        .drop(*params.columns)
    )


def sigma_threshold(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """mean + k * population std of the losses."""
    return df.agg(
        F.avg(col).alias("mean_loss"),
        F.stddev_pop(col).alias("std_loss"),
        (F.avg(col) + k * F.stddev_pop(col)).alias("threshold"),
    )


def score_summary(df: DataFrame, col: str = "score", margin: float = SUGGESTED_MARGIN) -> DataFrame:
    return df.agg(
        F.min(col).alias("min_score"),
        F.max(col).alias("max_score"),
        F.avg(col).alias("mean_score"),
        (F.min(col) - margin).alias("suggested_threshold"),
    )


def contamination_offset(
    df: DataFrame,
    contamination: float = CONTAMINATION,
    col: str = "score",
    at_most: int | None = None,
) -> DataFrame:
    """Score below which the given share of the training rows lies (exact, interpolated)."""
    found = exact_quantile(df, col, contamination, at_most=at_most)
    return found.withColumnRenamed("quantile", "offset")


def detection_totals(df: DataFrame, status: str = "status") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(status) == "Anomaly").alias("anomalies"),
    )


def evaluate_verdicts(
    df: DataFrame, verdict: str = "status", label: str = "label", normal: str = "normal"
) -> DataFrame:
    """Verdicts per true label: on normal rows anomalies are false positives, on the others they
    are detections and the rest are misses."""
    flagged = F.col(verdict) == "Anomaly"
    is_normal = F.col(label) == normal
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_normal & ~flagged).alias("correct_normal"),
        F.count_if(is_normal & flagged).alias("false_positive"),
        F.count_if(~is_normal & flagged).alias("detected"),
        F.count_if(~is_normal & ~flagged).alias("missed"),
    )
