"""CSV tables, policies, fitted parameters and state snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import schemas
from fleetsight.sinks.tables import CSV_OPTIONS, state_before

DEFAULT_THRESHOLD = 0.5

# Policy defaults and the accepted actions.
POLICY_DEFAULTS = {
    "intervalSeconds": 10,
    "cpuThreshold": 90.0,
    "trustDecay": 5.0,
    "enforcementAction": "cordon",
    "autoRemediate": True,
}
POLICY_ACTIONS = ("log", "taint", "cordon", "drain")


def read_metrics_csv(spark: SparkSession, path: str, schema: str = schemas.METRICS_V1) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_node_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows whose last column is JSON text in the file and a map in the frame."""
    as_text = schemas.NODE_FEATURES.replace("MAP<STRING, BIGINT>", "STRING")
    rows = read_metrics_csv(spark, path, as_text)
    return rows.withColumn(
        "syscall_feature_vector", F.from_json("syscall_feature_vector", "MAP<STRING, BIGINT>")
    )


def read_scenario_windows(spark: SparkSession, path: str) -> DataFrame:
    """Scenario windows with ``pos`` = file order (file name, then offset within the file)."""
    rows = read_metrics_csv(spark, path, schemas.SCENARIO_WINDOWS)
    # Splits are read in order of size, so the row number alone is not the file order; it only
    # increases along one split.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn("pos", place)


def resolve_policy(df: DataFrame, on_invalid: str = "drop") -> DataFrame:
    """Fill defaults and check the rules: interval >= 1, known action.

    ``on_invalid``: ``drop`` leaves invalid policies out, ``fail`` stops the job.
    """
    filled = df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in POLICY_DEFAULTS.items()}
    )
    valid = (F.col("intervalSeconds") >= 1) & F.col("enforcementAction").isin(*POLICY_ACTIONS)
    if on_invalid == "fail":
        return filled.where(F.assert_true(valid, "invalid policy").isNull())
    return filled.where(valid)


def _read_or_none(spark: SparkSession, path: str, fmt: str, schema: str | None) -> DataFrame | None:
    try:
        reader = spark.read.format(fmt)
        if schema:
            reader = reader.schema(schema)
        return reader.load(path)
    except AnalysisException:
        return None


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Fitted parameter table (scaler, forest, model or threshold)."""
    return spark.read.parquet(path)


def load_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One-row threshold table; the default where none was saved."""
    found = _read_or_none(spark, path, "parquet", "threshold DOUBLE")
    if found is not None:
        return found
    return spark.range(1).select(F.lit(float(default)).alias("threshold"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state; empty where there is none yet."""
    found = state_before(spark, path)
    return found if found is not None else spark.createDataFrame([], schemas.NODE_STATE)
