"""Time grids of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps per array. A grid is unfolded in two levels, so one stray time, years away, makes neither an
# array nor a row of unbounded size.
BLOCK = 10_000


def width_micros(interval: str) -> Column:
    """Length of an interval such as ``10 seconds`` or ``1 day``."""
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")


def explode_steps(df: DataFrame, start: str, end: str, step: Column, out: str) -> DataFrame:
    """One row per ``step`` microseconds from ``start`` to ``end`` (inclusive) of each row; rows whose
    end lies before their start give none."""
    begin = F.unix_micros(F.col(start).cast("timestamp"))
    last = F.floor((F.unix_micros(F.col(end).cast("timestamp")) - begin) / step).cast("long")
    blocks = df.withColumns({"_begin": begin, "_n": last}).where("_n >= 0").withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, _n, {BLOCK}L)"))
    )
    steps = blocks.withColumn("_i", F.explode(F.expr(f"sequence(_block, least(_block + {BLOCK - 1}, _n))")))
    return steps.withColumn(out, F.timestamp_micros(F.col("_begin") + F.col("_i") * step)).drop(
        "_begin", "_n", "_block", "_i"
    )
