"""The record detector works on each line once."""

import contextlib
import io
import json
import re

from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.functions.signing import sign_text
from fleetsight.jobs.detect import detect_v1, verify_and_score
from fleetsight.plans.ordered import ROWS_PER_CHUNK_CONF

SECRET = "s"


def _lines(spark, n):
    """One busy node with two thirds of the rows, and every 90th line tampered with."""
    texts = []
    for i in range(n):
        record = {"node": "busy" if i % 3 else f"n{i % 7}", "timestamp": 1000.0 + i, "cpu": float(i * 37 % 100),
                  "mem": 1.0, "net_out": 1, "net_in": 1, "latency": 1.0}
        text = json.dumps(record, sort_keys=True)
        signature = sign_text(text, "other" if i % 90 == 89 else SECRET)
        texts.append((json.dumps({**record, "signature": signature}),))
    return spark.createDataFrame(texts, "raw STRING").repartition(4)


def _detect(lines):
    return detect_v1(lines, SECRET, lambda: -F.col("cpu"), -50.0, now=F.lit(1000.0))


def test_lines_are_read_once_with_split_nodes(spark):
    lines = _lines(spark, 600)
    whole = sorted(_detect(lines).collect())
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    spark.conf.set(ROWS_PER_CHUNK_CONF, "50")
    try:
        split = sorted(_detect(lines.mapInArrow(counted, lines.schema)).collect())
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert len(whole) == 600 and split == whole
    assert read.value == 600


def _explained(df, mode):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def test_line_steps_run_once_and_compile(spark):
    """The signature check and each JSON parse stand in the plan once, and no generated method is
    beyond the 8,000 bytes that the JVM compiles."""
    events = ad.events(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = verify_and_score(
            ad.metric_lines(events, SECRET), SECRET, lambda: F.col("cpu"), now=F.col("arrival")
        )
        plan = _explained(scored, "simple")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _explained(scored, "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("from_json(") == 2
    assert sizes and max(sizes) < 8000
