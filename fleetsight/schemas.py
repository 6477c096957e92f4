"""Explicit schemas of every record layout (nothing is inferred on read)."""

from __future__ import annotations

# Byte counters may come as any number, also with a fraction; a whole-number type would lose those.
METRICS_V1 = (
    "node STRING, timestamp DOUBLE, cpu DOUBLE, mem DOUBLE, "
    "net_out DOUBLE, net_in DOUBLE, latency DOUBLE"
)

SIGNED_RECORD = METRICS_V1 + ", signature STRING"

METRICS_V2 = (
    "timestamp TIMESTAMP, instance STRING, cpu DOUBLE, mem DOUBLE, "
    "net_in DOUBLE, net_out DOUBLE"
)

KERNEL_EVENT = (
    "node_name STRING, time STRING, "
    "process_exec STRUCT<process: STRUCT<binary: STRING>>, "
    "process_kprobe STRUCT<function_name: STRING, "
    "args: ARRAY<STRUCT<sock_arg: STRUCT<dport: INT>>>>"
)

# The last column is a map inside the engine and JSON text in CSV files.
NODE_FEATURES = (
    "timestamp TIMESTAMP, label STRING, node STRING, "
    "avg_cpu DOUBLE, avg_mem DOUBLE, net_bytes_in DOUBLE, net_bytes_out DOUBLE, "
    "exec_count BIGINT, unique_process_count BIGINT, tmp_exec_count BIGINT, "
    "outbound_connect_count BIGINT, mining_port_count BIGINT, "
    "syscall_feature_vector MAP<STRING, BIGINT>"
)

SCENARIO_WINDOWS = "start_time BIGINT, end_time BIGINT, label STRING, workload STRING"

INSTANT_VECTOR = (
    "status STRING, data STRUCT<result: ARRAY<STRUCT<"
    "metric: MAP<STRING, STRING>, value: ARRAY<STRING>>>>"
)

RANGE_MATRIX = (
    "status STRING, data STRUCT<result: ARRAY<STRUCT<"
    "metric: MAP<STRING, STRING>, values: ARRAY<ARRAY<STRING>>>>>"
)

NODE_STATE = (
    "node STRING, last_seen DOUBLE, cpu DOUBLE, score DOUBLE, status STRING, raw_status STRING"
)

POLICY = (
    "name STRING, intervalSeconds INT, cpuThreshold DOUBLE, trustDecay DOUBLE, "
    "enforcementAction STRING, autoRemediate BOOLEAN"
)

# Feature order of the two detector generations.
FEATURES_V1 = ("cpu", "mem", "net_in", "net_out", "latency")
FEATURES_V2 = ("cpu", "mem", "net_in", "net_out")

# The count columns and gauges of a feature row.
EVENT_COUNTS = (
    "exec_count",
    "unique_process_count",
    "tmp_exec_count",
    "outbound_connect_count",
    "mining_port_count",
)
NODE_GAUGES = ("avg_cpu", "avg_mem", "net_bytes_in", "net_bytes_out")
