"""Metric-store payloads as nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import schemas


def parse_instant_vector(
    df: DataFrame,
    payload_col: str,
    default_instance: str = "unknown",
    by: Sequence[str] = (),
) -> DataFrame:
    """Instant-vector JSON -> one (instance, value) row per payload.

    ``by`` names the columns that identify a payload (tick, metric). Values are text in the
    payload. A repeated instance keeps its last value; failed or empty payloads give no rows, and one
    value that is no number voids its payload. Row-local: no shuffle.
    """

    def sample(s: Column, pos: Column) -> Column:
        return F.struct(
            F.coalesce(s["metric"]["instance"], F.lit(default_instance)).alias("instance"),
            pos.alias("pos"),
            F.get(s["value"], F.lit(1)).try_cast("double").alias("value"),
        )

    # In order of instance and position: a sample is the last of its instance if the next differs.
    samples = (
        df.select(*by, F.from_json(payload_col, schemas.INSTANT_VECTOR).alias("_p"))
        .where(F.coalesce(F.col("_p.status"), F.lit("success")) == "success")
        .select(*by, F.array_sort(F.transform("_p.data.result", sample)).alias("_s"))
        .where(~F.exists("_s", lambda s: s["value"].isNull()))
    )
    last = F.filter(
        "_s",
        lambda s, i: ~F.coalesce(F.get(F.col("_s"), i + 1)["instance"] == s["instance"], F.lit(False)),
    )
    return samples.select(*by, F.explode(last).alias("_s")).select(*by, "_s.instance", "_s.value")


def parse_range_matrix(
    df: DataFrame, payload_col: str, default_instance: str = "unknown", by: Sequence[str] = ()
) -> DataFrame:
    """Range-matrix JSON -> (instance, ts, value) samples. Row-local: no shuffle."""
    return (
        df.select(*by, F.from_json(payload_col, schemas.RANGE_MATRIX).alias("_p"))
        .select(*by, F.explode("_p.data.result").alias("_s"))
        .select(
            *by,
            F.coalesce(F.col("_s.metric")["instance"], F.lit(default_instance)).alias("instance"),
            F.explode("_s.values").alias("_v"),
        )
        .select(
            *by,
            "instance",
            F.get("_v", F.lit(0)).try_cast("double").alias("ts"),
            F.get("_v", F.lit(1)).try_cast("double").alias("value"),
        )
    )
