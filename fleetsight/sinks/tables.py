"""Table sinks: append, replace, partitioned dataset, state log, report, actions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight import schemas
from fleetsight.functions.scalars import fixed_decimals, fixed_width, map_json

KEEP_VERSIONS = 3

# Quotes inside a cell are doubled, as common CSV readers and writers do.
CSV_OPTIONS = {"header": "true", "escape": '"'}
# The default cuts times to milliseconds.
_WHOLE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _csv_ready(df: DataFrame) -> DataFrame:
    maps = {f.name: map_json(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.MapType)}
    return df.withColumns(maps) if maps else df


def _save(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    if fmt == "csv":
        _csv_ready(df).write.mode(mode).options(**CSV_OPTIONS, timestampFormat=_WHOLE_TIME).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows. Every CSV part carries its header, so a reader sees it once per file."""
    _save(df, path, fmt, "append")


def write_table(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> None:
    """Replace a dataset, columns in a fixed order."""
    _save(df.select(*columns) if columns else df, path, fmt, "overwrite")


def write_labeled(df: DataFrame, path: str, partition_by: Sequence[str] = ("label",)) -> None:
    """Labeled dataset as Parquet folders per label (and date, if listed).

    ``rebalance`` gathers each label into few files, and splits a label that is most of the
    data over several writers at run time.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(
        path
    )


def save_params(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# -------------------------------------------------------------- current state as a log
#
# A state folder has deltas ``d<version>`` (the nodes of one batch), bases ``b<version>`` (all nodes) and
# manifests ``m<version>``: JSON that names one base and the deltas after it, oldest first, with their
# rows. A manifest appears by a rename once its tables are complete, so a writer that dies leaves the
# state before it as it was.

# A base is written anew when the deltas hold as many rows, and at least so many.
COMPACTED_ROWS = 10_000


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, root = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict | None:
    """The newest manifest (below a version)."""
    versions = [int(n[1:]) for n in _listed(spark, path) if n[0] == "m" and n[1:].isdigit()]
    versions = [v for v in versions if below is None or v < below]
    if not versions:
        return None
    fs, file = _folder(spark, f"{path}/m{max(versions)}")
    stream = fs.open(file)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return json.loads(text)


def _write_manifest(spark: SparkSession, path: str, version: int, parts: list[dict]) -> None:
    fs, draft = _folder(spark, f"{path}/_m{version}-{uuid.uuid4().hex}")
    _, final = _folder(spark, f"{path}/m{version}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
    stream.close()
    if fs.exists(final):  # a replayed batch
        fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"could not publish version {version} in {path}")


def _merged(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """The newest row of each node over a base and the deltas after it."""
    names = T._parse_datatype_string(schemas.NODE_STATE).names
    rows = None
    for i, part in enumerate(parts):
        some = spark.read.schema(schemas.NODE_STATE).parquet(f"{path}/{part['name']}").withColumn("_v", F.lit(i))
        rows = some if rows is None else rows.unionByName(some)
    if len(parts) == 1:
        return rows.drop("_v")
    newest = F.max_by(F.struct(*[n for n in names if n != "node"]), F.struct("_v", "last_seen"))
    return rows.groupBy("node").agg(newest.alias("s")).select("node", "s.*")


def state_before(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest published state (below ``version``), or None."""
    found = _manifest(spark, path, version)
    return _merged(spark, path, found["parts"]) if found else None


def publish_state(updates: DataFrame, version: int, path: str) -> None:
    """Publish ``updates`` on top of the newest earlier state as ``version``.

    What is written follows the nodes touched, but for a new base now and then. A replayed version starts
    from the same predecessor and replaces itself: retries change nothing.
    """
    spark = updates.sparkSession
    names = T._parse_datatype_string(schemas.NODE_STATE).names
    newest = F.max_by(F.struct(*[n for n in names if n != "node"]), F.col("last_seen"))
    delta = updates.select(*names).groupBy("node").agg(newest.alias("s")).select("node", "s.*")

    def part(name: str) -> dict:
        return {"name": name, "rows": spark.read.schema(schemas.NODE_STATE).parquet(f"{path}/{name}").count()}

    earlier = _manifest(spark, path, version)
    delta.write.mode("overwrite").parquet(f"{path}/d{version}")
    parts = [*(earlier["parts"] if earlier else []), part(f"d{version}")]
    if len(parts) > 1 and sum(p["rows"] for p in parts[1:]) >= max(parts[0]["rows"], COMPACTED_ROWS):
        _merged(spark, path, parts).write.mode("overwrite").parquet(f"{path}/b{version}")
        parts = [part(f"b{version}")]
    _write_manifest(spark, path, version, parts)
    _forget(spark, path, version)


def _forget(spark: SparkSession, path: str, version: int) -> None:
    """Drop manifests older than the last ``KEEP_VERSIONS``, and tables that no manifest names."""
    listed = _listed(spark, path)
    versions = sorted(int(n[1:]) for n in listed if n[0] == "m" and n[1:].isdigit() and int(n[1:]) <= version)
    gone = [f"m{v}" for v in versions[:-KEEP_VERSIONS]]
    used = {p["name"] for v in versions[-KEEP_VERSIONS:] for p in _manifest(spark, path, v + 1)["parts"]}
    gone += [n for n in listed if n[0] in "bd" and n[1:].isdigit() and int(n[1:]) <= version and n not in used]
    for name in gone:
        fs, old = _folder(spark, f"{path}/{name}")
        fs.delete(old, True)


# ------------------------------------------------------------------------- text report


def detection_report(df: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Report rows ``node, cpu, score, status`` plus a marker on anomalies.

    Returns ``section`` (0 head, 1 rows, 2 totals), the order columns and ``line``.
    """
    text = fixed_width(
        [
            F.col("node"),
            fixed_decimals(F.col("cpu"), 1),
            fixed_decimals(F.col("score"), 3),
            F.col("status"),
        ],
        [15, 6, 8, 0],
    )
    anomaly = F.col("status") == "Anomaly"
    rows = df.select(
        F.lit(1).alias("section"),
        *order,
        F.when(anomaly, F.concat(text, F.lit(" <--- DETECTED"))).otherwise(text).alias("line"),
    )
    nulls = [F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in order]
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(anomaly).alias("a"))
    rule = "-" * 40
    head_text = f"{'Node':<15} {'CPU':<6} {'Score':<8} {'Status'}\n{rule}"
    head = df.sparkSession.range(1).select(
        F.lit(0).alias("section"), *nulls, F.lit(head_text).alias("line")
    )
    foot = totals.select(
        F.lit(2).alias("section"),
        *nulls,
        F.format_string(
            f"{rule}\nTotal Rows: %d\nAnomalies Detected: %d", F.col("n"), F.col("a")
        ).alias("line"),
    )
    return head.unionByName(rows).unionByName(foot)


def ordered_report(df: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Report lines in arrival order (a range-partitioned sort of short text rows)."""
    return detection_report(df, order).orderBy("section", *order).select("line")


def write_report(df: DataFrame, path: str, order: Sequence[str] = ("pos",)) -> None:
    """Report text in order; part files are numbered in that order."""
    ordered_report(df, order).write.mode("overwrite").text(path)


def actions_table(df: DataFrame, columns: Sequence[str] = ("node", "ts", "action")) -> DataFrame:
    """Only the rows on which an enforcement action fires."""
    return df.where(F.col("action").isNotNull()).select(*columns)
