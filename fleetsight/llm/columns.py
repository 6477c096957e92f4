"""Names for the columns of an input that an operator carries along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns but ``used`` under working names, and the columns that give it back as
    it was. So a given column may have any name, also one that an operator gives to its own."""
    names = {c: c if c in used else f"given_{i}" for i, c in enumerate(docs.columns)}
    away = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return away, [F.col(f"`{n}`").alias(c) for c, n in names.items()]
