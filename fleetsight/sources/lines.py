"""Tolerant JSON-lines sources: bad lines are dropped, reading goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight import schemas
from fleetsight.functions.scalars import is_json_object, parse_iso


_BLANKS = " \t\r\n\f\v"


def _text(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "raw")


def drop_blank(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Strip lines and drop the empty ones."""
    return df.withColumn(raw, F.trim(F.col(raw), F.lit(_BLANKS))).where(F.col(raw) != "")


def _objects(df: DataFrame, raw: str) -> DataFrame:
    # blank lines are no objects either, so one condition covers both
    stripped = F.trim(F.col(raw), F.lit(_BLANKS))
    return df.withColumn(raw, stripped).where(is_json_object(F.col(raw)))


def parse_metric_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw lines -> signed metric records; the raw text is kept for verification.

    Other columns of ``df`` (arrival time, offsets) pass through.
    """
    schema = T._parse_datatype_string(schemas.SIGNED_RECORD)
    others = [c for c in df.columns if c != raw]
    # As elements of arrays the stripped text and the record are made once per row, and not again in
    # each filter above.
    stripped = F.explode(F.array(F.trim(F.col(raw), F.lit(_BLANKS)))).alias(raw)
    objects = df.select(*others, stripped).where(is_json_object(F.col(raw)))
    record = F.explode(F.array(F.from_json(raw, schema))).alias("_r")
    return objects.select(*others, raw, record).select(
        *others, raw, *[F.col(f"_r.{n}") for n in schema.names]
    )


def read_metric_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_metric_lines(_text(spark, path, streaming))


def classify_event(df: DataFrame) -> DataFrame:
    """Tag each parsed event: exec wins over kprobe, a kprobe counts only as ``tcp_connect``."""
    return df.withColumn(
        "event_class",
        F.when(F.col("has_exec"), F.when(F.col("has_process"), "exec"))
        .when(F.col("function_name") == "tcp_connect", "connect")
        .otherwise("other"),
    )


def parse_kernel_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw lines -> flat kernel events.

    An exec event without a process keeps its row (its node is known from then on) with a null
    ``event_class`` and is counted nowhere.
    """
    schema = T._parse_datatype_string(schemas.KERNEL_EVENT)
    def has(name: str) -> Column:
        return F.array_contains("_keys", name)

    parsed = _objects(df, raw).withColumns(
        {"_e": F.from_json(raw, schema), "_keys": F.json_object_keys(raw)}
    )
    flat = parsed.select(
        *[c for c in df.columns if c != raw],
        raw,
        F.coalesce("_e.node_name", F.lit("unknown")).alias("node"),
        parse_iso(F.col("_e.time")).alias("event_time"),
        F.coalesce(F.get("_keys", F.lit(0)), F.lit("unknown")).alias("kind"),
        has("process_exec").alias("has_exec"),
        F.col("_e.process_exec.process").isNotNull().alias("has_process"),
        F.coalesce("_e.process_exec.process.binary", F.lit("")).alias("binary"),
        F.when(
            has("process_kprobe"), F.coalesce("_e.process_kprobe.function_name", F.lit(""))
        ).alias("function_name"),
        F.coalesce(
            F.transform("_e.process_kprobe.args", lambda a: a["sock_arg"]["dport"]),
            F.array().cast("array<int>"),
        ).alias("dports"),
    )
    return classify_event(flat)


def read_kernel_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_kernel_events(_text(spark, path, streaming))
