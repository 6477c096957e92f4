"""Registry of named queries over the standard tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def micros(col: str) -> Column:
    return F.unix_micros(col).alias(col)


def r6(col: Column | str, name: str | None = None) -> Column:
    c = F.round(col, 6)
    return c.alias(name or col) if (name or isinstance(col, str)) else c


def steps_text(seq: Column | str) -> Column:
    """Nested number arrays as text of whole hundredths: ``a,b;c,d``."""
    return F.array_join(
        F.transform(
            seq,
            lambda s: F.array_join(
                F.transform(s, lambda x: F.round(x * 100).cast("bigint").cast("string")), ","
            ),
        ),
        ";",
    )


# Byte counters of the metric lines.
NET = """CAST(event_id * 3 AS DOUBLE) AS net_out,
  event_id * 7 + CASE WHEN event_id % 43 = 6 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS net_in"""

# Events in telemetry shape, as the adapters build them.
E = """e AS (
  SELECT event_id, ts, epoch_us(ts) AS us, 'node-' || user_id AS node, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

# What is left of the kernel-event lines once parsed.
KERNEL = f"""{E}, parsed AS (
  SELECT event_id, ts, k,
         CASE WHEN event_id % 50 = 3 THEN 'unknown' ELSE node END AS node,
         CASE WHEN event_id % 50 <> 3 AND event_id % 10 = 9 THEN 'node_name'
              WHEN event_type IN ('error', 'signup') THEN 'process_kprobe'
              WHEN event_type IN ('click', 'view') THEN 'process_exec'
              ELSE 'process_exit' END AS kind,
         CASE WHEN event_type IN ('click', 'view')
              THEN CASE WHEN event_id % 60 = 11 THEN NULL ELSE 'exec' END
              WHEN event_type = 'error' THEN 'connect' ELSE 'other' END AS event_class,
         CASE event_id % 5 WHEN 0 THEN '/tmp/' WHEN 1 THEN '/dev/shm/' ELSE '/usr/bin/' END || k
           AS bin
  FROM e WHERE event_id % 20 <> 7)"""


def features_sql(unit: str) -> str:
    """Feature rows per node and window, to be put in a WITH list after ``parsed``."""
    return f"""features AS (
  SELECT node, date_trunc('{unit}', ts) AS w,
         count(*) FILTER (event_class = 'exec') AS exec_count,
         count(DISTINCT bin) FILTER (event_class = 'exec') AS unique_process_count,
         count(*) FILTER (event_class = 'exec' AND event_id % 5 IN (0, 1)) AS tmp_exec_count,
         count(*) FILTER (event_class = 'connect') AS outbound_connect_count,
         CAST(sum(CASE WHEN event_class = 'connect' THEN
             (CASE WHEN k * 101 IN (3333, 4444, 5555, 6666, 7777, 8332, 8333, 14433, 14444)
                   THEN 1 ELSE 0 END)
             + (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) ELSE 0 END) AS BIGINT)
           AS mining_port_count
  FROM parsed GROUP BY ALL)"""


def histogram_sql(unit: str) -> str:
    return f"""kinds AS (
  SELECT node, date_trunc('{unit}', ts) AS w, kind, count(*) AS n
  FROM parsed WHERE event_class IS NOT NULL GROUP BY ALL),
histogram AS (
  SELECT node, w, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS h
  FROM kinds GROUP BY ALL)"""


def samples_sql(unit: str) -> str:
    return f"""samples AS (
  SELECT node, date_trunc('{unit}', ts) AS w,
         CASE event_type WHEN 'click' THEN 'avg_cpu' WHEN 'view' THEN 'avg_mem'
           WHEN 'purchase' THEN 'net_bytes_in' ELSE 'net_bytes_out' END AS metric,
         max(value) AS value
  FROM e WHERE event_type <> 'error' GROUP BY ALL)"""


COUNT_NAMES = (
    "exec_count, unique_process_count, tmp_exec_count, outbound_connect_count, mining_port_count"
)

# Counter samples: running cents per node, wrapped to force resets; growth with resets removed.
COUNTERS = f"""{E}, c AS (
  SELECT node, us,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY node ORDER BY us)
              AS BIGINT) % 50000 AS value FROM e),
d AS (SELECT *, lag(value) OVER (PARTITION BY node ORDER BY us) AS p FROM c),
g AS (SELECT node, us, value, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value
         ELSE value - p END) OVER (PARTITION BY node ORDER BY us) AS BIGINT) AS grown FROM d)"""

# Score traces: list of steps up to each row, reduced by the clamped step.
CLAMPED = "lambda s, x: least(100.0, greatest(0.0, s + x))"


def trust_sql(decay: float, recovery: float, tampered: bool = False) -> str:
    step = f"CASE WHEN event_type = 'error' THEN -{decay} ELSE {recovery} END"
    if tampered:
        step = f"CASE WHEN event_id % 97 = 0 THEN -1000.0 ELSE {step} END"
    return f"""{E}, steps AS (
  SELECT *, event_id % 97 = 0 AS tampered,
         list(CAST({step} AS DOUBLE)) OVER (PARTITION BY node ORDER BY us, event_id) AS ds,
         bool_or(event_id % 97 = 0) OVER (PARTITION BY node ORDER BY us, event_id) AS seen
  FROM e),
scored AS (SELECT *, list_reduce(ds, {CLAMPED}, CAST(100.0 AS DOUBLE)) AS score FROM steps),
status AS (
  SELECT *, CASE WHEN score < 30 THEN 'Banned' WHEN score < 75 THEN 'Probation'
                 ELSE 'Healthy' END AS score_status FROM scored)"""


TRANSITIONS = f"""{trust_sql(15.0, 2.0, True)}, named AS (
  SELECT *, CASE WHEN seen THEN 'Compromised' ELSE score_status END AS status FROM status),
pairs AS (
  SELECT *, coalesce(lag(status) OVER (PARTITION BY node ORDER BY us, event_id), 'Healthy')
    AS prev_status FROM named),
acted AS (
  SELECT *, CASE WHEN tampered THEN 'BAN' WHEN status = 'Compromised' THEN NULL
    WHEN status = 'Banned' AND prev_status <> 'Banned' THEN 'BAN'
    WHEN status = 'Probation' AND prev_status = 'Healthy' THEN 'TAINT'
    WHEN status = 'Healthy' AND prev_status = 'Probation' THEN 'UNTAINT'
    WHEN status = 'Healthy' AND prev_status = 'Banned' THEN 'UNCORDON+UNTAINT' END AS action
  FROM pairs)"""

LATEST = f"""{TRANSITIONS}, latest AS (
  SELECT node, max_by(us, us) AS us, max_by(value, us) AS cpu, max_by(score, us) AS score,
         max_by(status, us) AS status,
         max_by(CASE WHEN tampered THEN 'Tampered' WHEN event_type = 'error' THEN 'Anomaly'
                ELSE 'Normal' END, us) AS raw_status
  FROM acted GROUP BY node)"""
