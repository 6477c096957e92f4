"""Training, calibration and validation jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetsight.operators.forest import (
    Forest,
    fit_and_score_iforest,
    forest_from_tables,
    forest_tables,
)
from fleetsight.operators.predicates import select_features
from fleetsight.operators.reconstruct import (
    Reconstruction,
    augment_noise,
    calibrate,
    fit_reconstruction,
    reconstruction_from_table,
    reconstruction_table,
    score_reconstruction,
)
from fleetsight.operators.scaling import (
    evaluate_verdicts,
    fit_minmax,
    fit_standard,
    fitted,
    minmax_scale,
    score_summary,
    standard_scale,
)
from fleetsight.operators.timeseries import make_sequences
from fleetsight.plans.kept import kept
from fleetsight.schemas import FEATURES_V1, FEATURES_V2
from fleetsight.sinks.tables import save_params
from fleetsight.sources.tables import load_params, load_threshold


@dataclass
class RecordModel:
    scaler: DataFrame
    forest: Forest
    summary: DataFrame


def train_v1(
    metrics: DataFrame,
    id_cols: Sequence[str] = ("node", "timestamp"),
    feats: Sequence[str] = FEATURES_V1,
    path: str | None = None,
    **kw,
) -> RecordModel:
    """Scaler, forest with its contamination offset, and the score summary that suggests a
    threshold."""
    data = select_features(metrics, feats, keep=id_cols)
    scaler = fitted(fit_standard(data, feats))
    spark = metrics.sparkSession
    if path:  # later steps read the saved row instead of refitting
        save_params(scaler, f"{path}/scaler")
        scaler = load_params(spark, f"{path}/scaler")
    scaled = standard_scale(data, feats, scaler)
    forest, scored = fit_and_score_iforest(scaled, feats, id_cols, (), **kw)
    summary = score_summary(scored)
    if path:
        nodes, meta = forest_tables(spark, forest)
        save_params(nodes, f"{path}/forest_nodes")
        save_params(meta, f"{path}/forest_meta")
        save_params(summary, f"{path}/summary")
        summary = load_params(spark, f"{path}/summary")
    return RecordModel(scaler, forest, summary)


def load_v1(spark: SparkSession, path: str) -> RecordModel:
    forest = forest_from_tables(
        load_params(spark, f"{path}/forest_nodes"), load_params(spark, f"{path}/forest_meta")
    )
    return RecordModel(
        load_params(spark, f"{path}/scaler"), forest, load_params(spark, f"{path}/summary")
    )


@dataclass
class SequenceModel:
    scaler: DataFrame
    model: Reconstruction
    threshold: DataFrame


def train_v2(
    metrics: DataFrame,
    feats: Sequence[str] = FEATURES_V2,
    key: Sequence[str] = ("instance",),
    ts: str = "timestamp",
    length: int = 10,
    k: int = 8,
    path: str | None = None,
) -> SequenceModel:
    """Scaler, bottleneck fitted on noisy sequences, threshold from the clean ones."""
    spark = metrics.sparkSession
    data = metrics.dropna(subset=list(feats))
    scaler = fitted(fit_minmax(data, feats))
    if path:
        save_params(scaler, f"{path}/scaler")
        scaler = load_params(spark, f"{path}/scaler")
    scaled = minmax_scale(data, feats, scaler)
    # One pass fits, one calibrates. The rows are kept, not the sequences, which are ten times as many.
    with kept(scaled.select(*key, ts, *feats)) as rows:
        seqs = make_sequences(rows, feats, length, by=key, order=[ts])
        model = fit_reconstruction(augment_noise(seqs, [*key, ts]), k)
        threshold = fitted(calibrate(seqs, model))
    if path:
        save_params(reconstruction_table(spark, model), f"{path}/model")
        save_params(threshold, f"{path}/threshold")
        threshold = load_threshold(spark, f"{path}/threshold")
    return SequenceModel(scaler, model, threshold)


def load_v2(spark: SparkSession, path: str) -> SequenceModel:
    return SequenceModel(
        load_params(spark, f"{path}/scaler"),
        reconstruction_from_table(load_params(spark, f"{path}/model")),
        load_threshold(spark, f"{path}/threshold"),
    )


def validate_v2(seqs: DataFrame, model: Reconstruction, threshold: float) -> DataFrame:
    """Verdict counts of labeled, scaled sequences (columns ``seq``, ``label``)."""
    return evaluate_verdicts(score_reconstruction(seqs, model, threshold))
