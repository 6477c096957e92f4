"""Session factory used by the bench, the tests and ad-hoc runs."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# On a cluster these come from spark-defaults; only the keys whose values change
# *results* (time zone) or that a local run needs are set here.
_SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Stream state beyond the heap of an executor.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def ship_code() -> None:
    """Send the package's task functions along with each task, so that workers need no copy of it
    on their path. Not needed where it is installed or passed with ``--py-files``."""
    import fleetsight

    cloudpickle.register_pickle_by_value(fleetsight)


def require_utc(spark: SparkSession) -> None:
    """Times without a zone are read as UTC, whatever the session was started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def get_session(
    app_name: str = "fleetsight",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    conf = {**_SEMANTIC_CONF, **_STATE_CONF}
    if master is not None:
        builder = builder.master(master)
        conf.update(_LOCAL_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. ``fallback`` is used only where
    that is unset (tests, single-machine runs).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is unset and no fallback folder was given")
    return fallback
