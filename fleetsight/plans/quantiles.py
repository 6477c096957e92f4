"""Exact quantiles without holding all distinct values in one aggregation buffer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUFFER_ROWS = 1_000_000  # up to here the built-in exact percentile keeps everything in one map
_ACCURACY = 20_000


def exact_quantile(
    df: DataFrame,
    col: str,
    p: float,
    buffer_rows: int = BUFFER_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """One row ``quantile``: linear interpolation at rank p * (n - 1).

    Beyond ``buffer_rows`` rows, a sketch of bounded size and rank error brackets the wanted
    rank. Each further pass sketches the bracket alone and shrinks it some 5000-fold. Where heavy
    ties at its ends stop that, they are counted and left out. At most ``buffer_rows`` rows are
    counted by value and ranked. All passes combine map side, and two rounds serve 10^12 rows.
    ``at_most``: known upper bound of the row count, which saves counting a small frame.
    """
    values = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    if at_most is not None and at_most <= buffer_rows:
        return values.agg(F.percentile("x", p).alias("quantile"))
    head = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    n, lo, hi = head.first()
    if n <= buffer_rows:
        return values.agg(F.percentile("x", p).alias("quantile"))
    rank = p * (n - 1)
    low, high = math.floor(rank), math.ceil(rank)
    first = _value_at(values, low, lo, hi, n, buffer_rows)
    upto, following = values.agg(
        F.count_if(F.col("x") <= first), F.min(F.when(F.col("x") > first, F.col("x")))
    ).first()
    second = first if upto > high else following
    found = first + (second - first) * (rank - low)
    return df.sparkSession.createDataFrame([(found,)], "quantile DOUBLE")


def _value_at(
    values: DataFrame, rank: int, lo: float, hi: float, n: int, buffer_rows: int
) -> float:
    """The value at a 0-based rank of ``n`` values between lo and hi."""
    x = F.col("x")
    below, inside = 0, n
    while inside > buffer_rows and lo < hi:
        slack = 2.0 / _ACCURACY + 2.0 / inside
        at = (rank - below) / inside
        edges = [max(0.0, at - slack), min(1.0, at + slack)]
        bracket = values.where(x.between(lo, hi))
        new_lo, new_hi = bracket.agg(F.percentile_approx("x", edges, _ACCURACY)).first()[0]
        if (new_lo, new_hi) != (lo, hi):
            lo, hi = new_lo, new_hi
            below, inside = values.agg(F.count_if(x < lo), F.count_if(x.between(lo, hi))).first()
            continue
        between = F.when((x > lo) & (x < hi), x)
        at_lo, at_hi, in_lo, in_hi = values.agg(
            F.count_if(x == lo), F.count_if(x == hi), F.min(between), F.max(between)
        ).first()
        if rank < below + at_lo:
            return lo
        if rank >= below + inside - at_hi:
            return hi
        lo, hi, below, inside = in_lo, in_hi, below + at_lo, inside - at_lo - at_hi
    if lo == hi:
        return lo
    # at most ``buffer_rows`` rows
    counts = values.where(x.between(lo, hi)).groupBy("x").agg(F.count("x").alias("c"))
    upto = F.sum("c").over(Window.orderBy("x")) + below - 1
    return counts.withColumn("last", upto).where(F.col("last") >= rank).agg(F.min("x")).first()[0]
