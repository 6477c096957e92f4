"""Intermediate results that several passes read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and return a frame that reads the result, for plans that use it in
    several places. It lives in ``spark.checkpoint.dir`` like a checkpoint (and, like one, is
    cleared with that folder); where that is unset the frame is persisted."""
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{shared}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` for the passes inside the block.

    With ``spark.checkpoint.dir`` set it is written there once as a Parquet table, which outlives
    lost executors and is read back column by column. Where that is unset (single machine) the
    frame is persisted instead.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield held
        finally:
            held.unpersist()
        return
    path = f"{shared}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
