"""Streams whose state is a set of tables, worked on by batch operators.

A keyed processor is called once per key and micro-batch and asks the state store value by value; with
very many keys, or micro-batches as large as a backlog, that is most of the work. Here a step takes a
micro-batch and the state tables left by the one before, and returns its output and the new state, all as
frames that Catalyst plans. Each micro-batch reads and writes the whole state once, so this form suits
large micro-batches, and the processors suit small ones over large states.

Output and state are written under the batch id, so a replay overwrites itself and restarts change nothing.
The state of the last two micro-batches is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight.plans.grids import width_micros

State = dict[str, DataFrame]
Step = Callable[[DataFrame, State], tuple[DataFrame, State]]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stream_steps(
    source: DataFrame, step: Step, tables: Sequence[str], root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run ``step`` on each micro-batch of ``source``. ``tables`` are the names of its state; the first
    micro-batch gets none. Output is written to ``root/out/batch=N``, state to ``root/state/N``."""
    spark = source.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        # Read back by the session of the caller: that of the stream plans without run-time statistics.
        arrived = f"{root}/arrived/{batch_id}"
        batch.write.mode("overwrite").parquet(arrived)
        rows = spark.read.schema(batch.schema).parquet(arrived)
        before: State = {}
        if batch_id > 0:
            before = {name: spark.read.parquet(f"{root}/state/{batch_id - 1}/{name}") for name in tables}
        out, after = step(rows, before)
        for name in tables:
            after[name].write.mode("overwrite").parquet(f"{root}/state/{batch_id}/{name}")
        out.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        _delete(spark, arrived)
        _delete(spark, f"{root}/state/{batch_id - 2}")

    return (
        source.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def watermarks(times: DataFrame, before: State, delay: str) -> tuple[int, int, DataFrame]:
    """The watermark in milliseconds before and after a micro-batch, as a stream has it, and the state
    table ``clock``. ``times``: one column ``us``."""
    spark = times.sparkSession
    old = before["clock"].first()["ms"] if before else 0
    newest, late = times.select(F.max("us").alias("us"), F.lit(0)).select("us", width_micros(delay)).first()
    new = old if newest is None else max(old, newest // 1000 - late // 1000)
    return old, new, spark.createDataFrame([(new,)], "ms LONG")
