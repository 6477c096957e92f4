"""Sequence reconstruction detector: a linear bottleneck fitted by principal directions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.operators.forest import constant_array
from fleetsight.operators.predicates import classify
from fleetsight.operators.scaling import sigma_threshold

BOTTLENECK = 8
NOISE_SIGMA = 0.01
SEED = 42


def flatten_sequence(seq: str | Column) -> Column:
    return F.flatten(seq)


def sequence_mae(df: DataFrame, a: str, b: str, out: str = "mae") -> DataFrame:
    """Mean absolute difference over all steps and features of two nested arrays."""
    diffs = F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: F.abs(x - y))
    mean = F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d) / F.size(diffs)
    return df.withColumn(out, mean)


def augment_noise(
    seqs: DataFrame,
    id_cols: Sequence[str],
    sigma: float = NOISE_SIGMA,
    seed: int = SEED,
    col: str = "seq",
) -> DataFrame:
    """Gaussian noise on every element.

    Box-Muller over hashes of (row identity, position): a re-run task adds the same noise, which
    ``randn`` (tied to partition and row order) does not promise.
    """
    unit = float(1 << 32)

    def gauss(i: Column, j: Column) -> Column:
        h = F.xxhash64("_noise", i, j)  # its halves are the two uniform numbers
        u1 = (F.shiftrightunsigned(h, 32).cast("double") + 0.5) / unit
        u2 = F.pmod(h, F.lit(1 << 32)).cast("double") / unit
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)

    noisy = F.transform(
        col,
        lambda step, i: F.transform(step, lambda x, j: x + sigma * gauss(i, j)),
    )
    row_hash = F.xxhash64(*id_cols, F.lit(seed))
    return seqs.withColumn("_noise", row_hash).withColumn(col, noisy).drop("_noise")


@dataclass
class Reconstruction:
    """Center and components of the fitted bottleneck (a few hundred numbers)."""

    mean: np.ndarray
    components: np.ndarray  # (width, k), orthonormal columns

    def loss(self, x: np.ndarray) -> np.ndarray:
        centered = x - self.mean
        rebuilt = centered @ self.components @ self.components.T
        missed = np.abs(centered - rebuilt)
        # Added in the order of the sequence, as ``loss_expression`` does: ``mean`` adds in an order of
        # its own, and a loss at the threshold would get another verdict here than there.
        total = np.zeros(len(missed))
        for column in missed.T:
            total += column
        return total / missed.shape[1]

    def loss_column(self, flat: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def loss(rows: pd.Series) -> pd.Series:
            if len(rows) == 0:
                return pd.Series([], dtype=float)
            return pd.Series(model.loss(np.stack(rows.to_numpy())))

        return loss(flat)

    def loss_expression(self, flat: Column) -> Column:
        """The same loss as a column of built-in functions, without Python workers. Null where the
        sequence or one of its elements is; its length must be the model's."""
        mean, zero = constant_array(self.mean), F.lit(0.0)
        rows = constant_array(self.components, "array<double>")  # per element of the sequence
        columns = constant_array(self.components.T, "array<double>")

        def dot(a: Column, b: Column) -> Column:
            return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)

        def loss(centered: Column) -> Column:
            def rest(codes: Column) -> Column:
                missed = F.zip_with(centered, rows, lambda x, weights: F.abs(x - dot(codes, weights)))
                return F.aggregate(missed, zero, lambda s, x: s + x) / float(len(self.mean))

            codes = F.transform(columns, lambda weights: dot(centered, weights))
            return F.get(F.transform(F.array(codes), rest), F.lit(0))  # binds the codes once

        centered = F.zip_with(flat, mean, lambda x, m: x - m)
        return F.get(F.transform(F.array(centered), loss), F.lit(0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(count, sums, sums of products) of a task's vectors, in one row."""
    n, sums, products = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
    if n:
        yield _moment_row(n, sums, products)


def _moment_row(n: int, sums: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([sums.tolist()]), pa.array([products.ravel().tolist()])],
        names=["n", "s", "p"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        yield _moment_row(
            sum(r["n"] for r in rows),
            np.sum([r["s"] for r in rows], axis=0),
            np.sum([r["p"] for r in rows], axis=0),
        )


# Tasks whose sums the driver adds up; those of more tasks are added in this many tasks first.
_SUMMED = 64


def fit_reconstruction(seqs: DataFrame, k: int = BOTTLENECK, col: str = "seq") -> Reconstruction:
    """Top-k principal directions of the flattened sequences, from one pass: each task adds up counts,
    sums and products, and only width x width numbers reach the driver. No sequence is stored."""
    schema = "n LONG, s ARRAY<DOUBLE>, p ARRAY<DOUBLE>"
    parts = seqs.select(F.flatten(col).alias("x")).mapInArrow(_moments, schema)
    rows = parts.repartition(_SUMMED).mapInArrow(_added, schema).collect()
    if not rows:
        raise ValueError("no sequences to fit")
    n = sum(r["n"] for r in rows)
    mean = np.sum([r["s"] for r in rows], axis=0) / n
    width = len(mean)
    products = np.sum([r["p"] for r in rows], axis=0).reshape(width, width)
    values, vectors = np.linalg.eigh(products / n - np.outer(mean, mean))
    return Reconstruction(mean, vectors[:, np.argsort(-values, kind="stable")[:k]])


def score_reconstruction(
    seqs: DataFrame,
    model: Reconstruction,
    threshold: float | Column,
    col: str = "seq",
    out: str = "loss",
    native: bool = False,
) -> DataFrame:
    """Adds the reconstruction error and the verdict (anomaly only above the threshold). ``native``: by
    built-in functions instead of Arrow batches."""
    loss = model.loss_expression if native else model.loss_column
    scored = seqs.withColumn(out, loss(F.flatten(col)))
    return classify(scored, out, threshold, direction="high")


def calibrate(seqs: DataFrame, model: Reconstruction, k: float = 3.0, col: str = "seq") -> DataFrame:
    """Threshold row (mean + k sigma) from clean, noise-free training sequences."""
    return sigma_threshold(seqs.select(model.loss_column(F.flatten(col)).alias("loss")), "loss", k)


def reconstruction_table(spark: SparkSession, model: Reconstruction) -> DataFrame:
    rows = [
        (i, float(model.mean[i]), [float(v) for v in model.components[i]])
        for i in range(len(model.mean))
    ]
    return spark.createDataFrame(rows, "i INT, mean DOUBLE, weights ARRAY<DOUBLE>")


def reconstruction_from_table(df: DataFrame) -> Reconstruction:
    pdf = df.orderBy("i").toPandas()  # one row per sequence element
    return Reconstruction(pdf["mean"].to_numpy(), np.stack(pdf["weights"].to_numpy()))
