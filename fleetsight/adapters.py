"""Telemetry shapes derived from general-purpose tables (events, lineitem).

A user of an ``events`` table is taken as a node, an ``error`` as an anomaly, ``value`` as a
gauge. Each adapter is row-local unless it says otherwise, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.signing import keyed_sha256
from fleetsight.plans.ordered import ordered, total
from fleetsight.plans.sizing import spread
from fleetsight.session import require_utc

FOREST_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FOREST_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    require_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def forest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select(*FOREST_ID, *FOREST_FEATURES)
    return spread(items, *FOREST_ID)


def shape_events(raw: DataFrame) -> DataFrame:
    """Events with ``node``, a zoned timestamp ``ts``, epoch seconds and the number in props."""
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(load(spark, sf_dir, "events"))


def records(ev: DataFrame) -> DataFrame:
    """Scored metric records: anomaly = error event; every 97th record counts as tampered."""
    return ev.select(
        "node",
        "ts",
        "event_id",
        F.col("value").alias("cpu"),
        (F.col("event_type") == "error").alias("is_anomaly"),
        (F.col("event_id") % 97 == 0).alias("tampered"),
        F.when(F.col("event_id") % 97 == 0, "Tampered")
        .when(F.col("event_type") == "error", "Anomaly")
        .otherwise("Normal")
        .alias("raw_status"),
        (F.unix_micros("ts") / 1_000_000).alias("last_seen"),
    )


def _every(n: int, rest: int) -> Column:
    return F.col("event_id") % n == rest


def _as_lines(ev: DataFrame, line: Column, *keep: str | Column) -> DataFrame:
    """Text lines as a source would give them. Exploding a one-element array keeps the optimizer
    from copying the text expression into every filter on ``raw``."""
    return spread(ev, "event_id").select(*keep, F.explode(F.array(line)).alias("raw"))


def kernel_lines(ev: DataFrame) -> DataFrame:
    """Kernel-event JSON lines with the event's ``ts`` as arrival time.

    error -> tcp_connect to port 101*k (every third with a second socket on 4444), click/view ->
    exec, signup -> another probe, purchase -> exit. Every 20th line is malformed, every 50th
    lacks the node, some exec events lack the process, every 10th names the node first.
    """
    binary = F.concat(
        F.when(_every(5, 0), "/tmp/").when(_every(5, 1), "/dev/shm/").otherwise("/usr/bin/"),
        F.col("k").cast("string"),
    )
    second = F.when(_every(3, 0), ', {"sock_arg": {"dport": 4444}}').otherwise("")
    body = (
        F.when(
            F.col("event_type") == "error",
            F.concat(
                F.lit('"process_kprobe": {"function_name": "tcp_connect", "args": '),
                F.lit('[{"int_arg": 1}, {"sock_arg": {"dport": '),
                (F.col("k") * 101).cast("string"),
                F.lit("}}"),
                second,
                F.lit("]}"),
            ),
        )
        .when(
            F.col("event_type").isin("click", "view") & _every(60, 11),
            '"process_exec": {"note": 1}',
        )
        .when(
            F.col("event_type").isin("click", "view"),
            F.concat(F.lit('"process_exec": {"process": {"binary": "'), binary, F.lit('"}}')),
        )
        .when(
            F.col("event_type") == "signup",
            '"process_kprobe": {"function_name": "sys_write", '
            '"args": [{"sock_arg": {"dport": 3333}}]}',
        )
        .otherwise('"process_exit": {"code": 0}')
    )
    node = F.concat(F.lit('"node_name": "'), F.col("node"), F.lit('"'))
    line = (
        F.when(_every(40, 7), '{"process_exec": {"proc')
        .when(_every(40, 27), "[1]")
        .when(_every(50, 3), F.concat(F.lit("{"), body, F.lit("}")))
        .when(_every(10, 9), F.concat(F.lit("{"), node, F.lit(", "), body, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), body, F.lit(", "), node, F.lit("}")))
    )
    return _as_lines(ev, line, "ts", "event_id")


def _object(*cells: str | Column) -> Column:
    """JSON text of an object; null cells are left out."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))


def metric_lines(ev: DataFrame, secret: str) -> DataFrame:
    """Signed metric lines in event order, with the arrival time in epoch seconds.

    Every 50th line was altered after signing, every 41st lacks the latency, every 23rd the
    signature, every 31st is blank, cut off or no object; every 13th arrives 6 seconds late. Every
    43rd has a byte counter that is no whole number. Cells and lines are columns of their own: the
    text written out in one expression is code too large for the JVM to compile.
    """
    micros, value, k = F.unix_micros("ts"), F.col("value"), F.col("k").cast("string")
    fraction = F.rtrim(F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    stamp = F.concat(
        F.floor(micros / 1_000_000).cast("string"),
        F.lit("."),
        F.when(micros % 1_000_000 == 0, "0").otherwise(fraction),
    )
    net_in = F.concat(
        (F.col("event_id") * 7).cast("string"), F.when(_every(43, 6), ".5").otherwise("")
    )
    texts = {
        "node": F.concat(F.lit('"'), F.col("node"), F.lit('"')),
        "timestamp": stamp,
        "cpu": value.cast("string"),
        "mem": F.concat(k, F.lit(".5")),
        "net_out": (F.col("event_id") * 3).cast("string"),
        "net_in": net_in,
        "latency": F.when(~_every(41, 5), F.concat(k, F.lit(".25"))),
        "signed_cpu": F.when(_every(50, 0), value + 1).otherwise(value).cast("string"),
    }
    late = F.when(_every(13, 1), 6.0).otherwise(1.0)
    cells = spread(ev, "event_id").select(
        "event_id",
        (micros / 1_000_000 + late).alias("arrival"),
        *[
            F.concat(F.lit(f'"{n.removeprefix("signed_")}": '), text).alias(n)
            for n, text in texts.items()
        ],
    )
    payload = ("signed_cpu", "latency", "mem", "net_in", "net_out", "node", "timestamp")
    signature = keyed_sha256(_object(*payload), secret)
    claimed = F.when(~_every(23, 4), F.concat(F.lit('"signature": "'), signature, F.lit('"')))
    written = ("node", "timestamp", "cpu", "mem", "net_out", "net_in", "latency")
    lines = cells.select("event_id", "arrival", _object(*written, claimed).alias("line"))
    raw = (
        F.when(_every(93, 2), "   ")
        .when(_every(93, 33), F.substring("line", 1, 40))
        .when(_every(93, 64), "5")
        .otherwise(F.concat(F.lit(" "), "line"))
    )
    return lines.select("event_id", "arrival", F.explode(F.array(raw)).alias("raw"))


def metric_samples(ev: DataFrame, window: str) -> DataFrame:
    """Gauges per node and window: long (node, window_start, metric, value), the largest value."""
    metric = (
        F.when(F.col("event_type") == "click", "avg_cpu")
        .when(F.col("event_type") == "view", "avg_mem")
        .when(F.col("event_type") == "purchase", "net_bytes_in")
        .when(F.col("event_type") == "signup", "net_bytes_out")
    )
    return (
        ev.withColumn("metric", metric)
        .where(F.col("metric").isNotNull())
        .groupBy("node", F.window("ts", window).alias("w"), "metric")
        .agg(F.max("value").alias("value"))
        .select("node", F.col("w.start").alias("window_start"), "metric", "value")
    )


def counters(ev: DataFrame, wrap: int = 50_000) -> DataFrame:
    """Cumulative counter per node in integer cents, wrapping around to force resets."""
    cents = ev.select("node", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    rows = ordered(cents, ["node"], ["ts"]).running(_sum=total(F.col("cents")))
    return rows.with_columns(value=F.pmod("_sum", F.lit(wrap))).result().drop("_sum", "cents")


def scenario_windows(ev: DataFrame) -> DataFrame:
    """A labeled one-hour window per signup; event order is file order."""
    start = F.unix_timestamp("ts")
    return ev.where(F.col("event_type") == "signup").select(
        start.alias("start_time"),
        (start + 3600).alias("end_time"),
        F.concat(F.lit("scenario_"), (F.col("event_id") % 7).cast("string")).alias("label"),
        F.concat(F.lit("faults/w"), F.col("k").cast("string"), F.lit(".yaml")).alias("workload"),
        F.col("event_id").alias("pos"),
    )


def few_windows(ev: DataFrame) -> DataFrame:
    """Nine labeled windows laid over the time span of the table."""
    span = ev.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b"))
    step = F.expr("(b - a) div 9")
    return span.select("a", step.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos")).select(
        (F.col("a") + F.col("pos") * F.col("s")).alias("start_time"),
        (F.col("a") + (F.col("pos") + 1) * F.col("s") - 600).alias("end_time"),
        F.when(F.col("pos") % 4 == 0, "normal")
        .otherwise(F.concat(F.lit("scenario_"), F.col("pos").cast("string")))
        .alias("label"),
        F.lit("baseline").alias("workload"),
        "pos",
    )


def instant_payloads(ev: DataFrame) -> DataFrame:
    """One instant-vector payload per event: its node twice (the last value counts) and a
    second instance. Some lack the instance label, some report failure, some are empty."""
    value = F.col("value").cast("string")
    label = F.when(_every(29, 0), '{"job": "x"}').otherwise(
        F.concat(F.lit('{"instance": "'), F.col("node"), F.lit(':9100", "job": "x"}'))
    )
    stamp = F.unix_timestamp("ts").cast("string")

    def item(metric: Column, text: Column) -> Column:
        return F.concat(
            F.lit('{"metric": '), metric, F.lit(', "value": ['), stamp, F.lit(', "'), text, F.lit('"]}')
        )

    other = F.lit('{"instance": "spare:9100"}')
    result = F.concat_ws(
        ", ", item(label, F.lit("-1")), item(other, F.col("k").cast("string")), item(label, value)
    )
    payload = (
        F.when(_every(37, 2), '{"status": "error", "data": {"result": []}}')
        .when(_every(37, 3), '{"status": "success", "data": {"result": []}}')
        .when(_every(37, 4), "upstream timeout")
        .otherwise(
            F.concat(F.lit('{"status": "success", "data": {"result": ['), result, F.lit("]}}"))
        )
    )
    return _as_lines(ev, payload, "event_id", "event_type", "ts").withColumnRenamed(
        "raw", "payload"
    )


def range_payloads(ev: DataFrame) -> DataFrame:
    """One range-matrix payload per event with two samples of one series."""
    start = F.unix_timestamp("ts")
    payload = F.concat(
        F.lit('{"status": "success", "data": {"result": [{"metric": {"instance": "'),
        F.col("node"),
        F.lit(':9100"}, "values": [['),
        start.cast("string"),
        F.lit(', "'),
        F.col("value").cast("string"),
        F.lit('"], ['),
        (start + 5).cast("string"),
        F.lit(', "'),
        F.col("k").cast("string"),
        F.lit('"]]}]}}'),
    )
    return _as_lines(ev, payload, "event_id").withColumnRenamed("raw", "payload")


def metrics_v2(ev: DataFrame) -> DataFrame:
    """Metric rows (timestamp, instance, cpu, mem, net_in, net_out), one per event."""
    return ev.select(
        F.col("ts").alias("timestamp"),
        F.col("node").alias("instance"),
        F.col("value").alias("cpu"),
        F.col("k").cast("double").alias("mem"),
        (F.col("value") * F.when(F.col("event_type") == "error", 4).otherwise(1)).alias("net_in"),
        (F.col("event_id") % 100).cast("double").alias("net_out"),
    )


def chain_samples(ev: DataFrame) -> DataFrame:
    """Samples (node, metric, ts, value) as they arrive: two gauges and two counters per event."""
    of = {"cpu": F.col("value"), "mem": F.col("k"), "net_in": F.col("event_id") * 7, "net_out": F.col("event_id") * 3}
    samples = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in of.items()])
    return ev.select("node", "ts", F.inline(samples))


def busy_node(ev: DataFrame) -> DataFrame:
    """Nine tenths of all events come from one node."""
    return ev.withColumn("node", F.when(F.col("event_id") % 10 != 0, "node-busy").otherwise(F.col("node")))


def policies(ev: DataFrame) -> DataFrame:
    """A policy per event with gaps and invalid settings."""
    k = F.col("k")
    return ev.select(
        F.concat(F.lit("policy-"), F.col("event_id").cast("string")).alias("name"),
        F.when(k % 3 != 0, k % 5).alias("intervalSeconds"),
        F.when(k % 4 != 0, F.col("value")).alias("cpuThreshold"),
        F.when(k % 7 != 0, k.cast("double")).alias("trustDecay"),
        F.when(k % 6 == 0, "taint").when(k % 6 == 1, "explode").when(k % 6 == 2, "drain").alias(
            "enforcementAction"
        ),
        F.when(k % 2 == 0, k % 4 == 0).alias("autoRemediate"),
    )
