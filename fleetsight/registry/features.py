"""Queries: sources, event features, metric vectors, labeling, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.functions import scalars as S
from fleetsight.jobs.datasets import feature_dataset as build_features
from fleetsight.jobs.datasets import metric_rows_v1, metric_rows_v2
from fleetsight.operators import events as ops
from fleetsight.operators import predicates as pred
from fleetsight.operators import vectors as vec
from fleetsight.operators.labeling import label_by_windows as label_rows
from fleetsight.operators.labeling import label_dataset
from fleetsight.operators.labeling import label_totals as totals_of_labels
from fleetsight.registry.base import (
    NET,
    COUNT_NAMES,
    KERNEL,
    E,
    features_sql,
    histogram_sql,
    micros,
    query,
    r6,
    samples_sql,
)
from fleetsight.sources.lines import parse_kernel_events, parse_metric_lines
from fleetsight.sources.payloads import parse_instant_vector as instant
from fleetsight.sources.payloads import parse_range_matrix as matrix
from fleetsight.sources.tables import resolve_policy as resolve

SECRET = "demo-secret"  # a job parameter; fixed here so that runs can be compared


def _kernel(spark, sf_dir):
    return parse_kernel_events(ad.kernel_lines(ad.events(spark, sf_dir)))


# ------------------------------------------------------------------------------- sources


@query(
    f"""WITH {E} SELECT event_id, node, us / 1000000 AS timestamp, value AS cpu,
  k + 0.5::DOUBLE AS mem, {NET},
  CASE WHEN event_id % 41 <> 5 THEN k + 0.25::DOUBLE END AS latency,
  event_id % 23 <> 4 AS signed
FROM e WHERE event_id % 31 <> 2"""
)
def read_metric_lines(spark, sf_dir):
    lines = ad.metric_lines(ad.events(spark, sf_dir), SECRET)
    return parse_metric_lines(lines).select(
        "event_id", "node", "timestamp", "cpu", "mem", "net_out", "net_in", "latency",
        F.col("signature").isNotNull().alias("signed"),
    )


@query(
    f"""WITH {KERNEL} SELECT event_id, node, kind, event_class,
  CASE WHEN event_class = 'exec' THEN bin END AS bin,
  CASE WHEN event_class = 'connect' THEN CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END
       WHEN event_class = 'other' AND event_id IN (SELECT event_id FROM e WHERE event_type = 'signup')
       THEN 1 ELSE 0 END AS n_args
FROM parsed"""
)
def read_kernel_events(spark, sf_dir):
    return _kernel(spark, sf_dir).select(
        "event_id",
        "node",
        "kind",
        "event_class",
        F.when(F.col("event_class") == "exec", F.col("binary")).alias("bin"),
        F.size("dports").alias("n_args"),
    )


@query(
    f"""WITH {E}, ok AS (SELECT * FROM e WHERE event_id % 37 NOT IN (2, 3, 4))
SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE node || ':9100' END AS instance,
  value FROM ok
UNION ALL SELECT event_id, 'spare:9100', CAST(k AS DOUBLE) FROM ok"""
)
def parse_instant_vector(spark, sf_dir):
    payloads = ad.instant_payloads(ad.events(spark, sf_dir))
    return instant(payloads, "payload", "unknown", by=["event_id"])


@query(
    f"""WITH {E} SELECT event_id, node || ':9100' AS instance,
  CAST(us // 1000000 AS DOUBLE) AS ts, value FROM e
UNION ALL SELECT event_id, node || ':9100', CAST(us // 1000000 + 5 AS DOUBLE), CAST(k AS DOUBLE)
FROM e"""
)
def parse_range_matrix(spark, sf_dir):
    payloads = ad.range_payloads(ad.events(spark, sf_dir))
    return matrix(payloads, "payload", by=["event_id"])


@query(
    f"""WITH {E}, p AS (SELECT 'policy-' || event_id AS name,
  coalesce(CASE WHEN k % 3 <> 0 THEN k % 5 END, 10) AS intervalSeconds,
  coalesce(CASE WHEN k % 4 <> 0 THEN value END, 90.0) AS cpuThreshold,
  coalesce(CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) END, 5.0) AS trustDecay,
  coalesce(CASE k % 6 WHEN 0 THEN 'taint' WHEN 1 THEN 'explode' WHEN 2 THEN 'drain' END, 'cordon')
    AS enforcementAction,
  coalesce(CASE WHEN k % 2 = 0 THEN k % 4 = 0 END, true) AS autoRemediate FROM e)
SELECT * FROM p WHERE intervalSeconds >= 1 AND enforcementAction <> 'explode'"""
)
def resolve_policy(spark, sf_dir):
    return resolve(ad.policies(ad.events(spark, sf_dir)))


# ------------------------------------------------------------------- projections and filters


@query(
    f"""WITH {E} SELECT node, us / 1000000 AS timestamp, value AS cpu, k + 0.5::DOUBLE AS mem,
  {NET},
  CASE WHEN event_id % 41 <> 5 THEN k + 0.25::DOUBLE ELSE 0 END AS latency
FROM e WHERE event_id % 31 <> 2"""
)
def project_defaults(spark, sf_dir):
    return metric_rows_v1(ad.metric_lines(ad.events(spark, sf_dir), SECRET))


@query(
    f"""WITH {E} SELECT event_id, value AS cpu, k + 0.5::DOUBLE AS mem, {NET}, k + 0.25::DOUBLE AS latency
FROM e WHERE event_id % 31 <> 2 AND event_id % 41 <> 5"""
)
def select_features(spark, sf_dir):
    lines = parse_metric_lines(ad.metric_lines(ad.events(spark, sf_dir), SECRET))
    return pred.select_features(
        lines, ("cpu", "mem", "net_in", "net_out", "latency"), keep=["event_id"]
    )


@query(
    f"""WITH {E} SELECT event_id FROM e WHERE event_id % 31 <> 2 AND event_id % 13 <> 1"""
)
def drop_stale(spark, sf_dir):
    lines = parse_metric_lines(ad.metric_lines(ad.events(spark, sf_dir), SECRET))
    return pred.drop_stale(lines, 5.0, F.col("arrival")).select("event_id")


@query(f"WITH {E} SELECT event_id, node FROM e WHERE NOT contains(node, '-1')")
def exclude_nodes(spark, sf_dir):
    return pred.exclude_nodes(ad.events(spark, sf_dir), "-1").select("event_id", "node")


@query(f"WITH {E} SELECT event_id, value FROM e WHERE event_type = 'click' AND k % 2 = 0")
def select_series(spark, sf_dir):
    samples = ad.events(spark, sf_dir).select(
        "event_id",
        F.col("event_type").alias("metric"),
        F.create_map(
            F.lit("mode"), F.when(F.col("k") % 2 == 0, "idle").otherwise("user")
        ).alias("labels"),
        "value",
    )
    return pred.select_series(samples, "click", {"mode": "idle"}).select("event_id", "value")


# -------------------------------------------------------------------------- event features


@query(
    f"""WITH {KERNEL}, {features_sql('hour')}
SELECT node, epoch_us(w) AS window_start, {COUNT_NAMES} FROM features"""
)
def event_features(spark, sf_dir):
    out = ops.event_features(_kernel(spark, sf_dir), "1 hour")
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query(
    f"""WITH {KERNEL}, {histogram_sql('hour')}
SELECT node, epoch_us(w) AS window_start, h AS syscall_feature_vector FROM histogram"""
)
def event_histogram(spark, sf_dir):
    out = ops.event_histogram(_kernel(spark, sf_dir), "1 hour")
    return out.select(
        "node",
        micros("window_start"),
        S.map_json(F.col("syscall_feature_vector")).alias("syscall_feature_vector"),
    )


@query(
    f"""WITH {KERNEL}, {samples_sql('day')}
SELECT node FROM parsed UNION SELECT node FROM samples"""
)
def known_nodes(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    return ops.known_nodes(parse_kernel_events(ad.kernel_lines(ev)), ad.metric_samples(ev, "1 day"))


_GAUGES_SQL = """coalesce(max(value) FILTER (metric = 'avg_cpu'), 0.0) AS avg_cpu,
  coalesce(max(value) FILTER (metric = 'avg_mem'), 0.0) AS avg_mem,
  coalesce(max(value) FILTER (metric = 'net_bytes_in'), 0.0) AS net_bytes_in,
  coalesce(max(value) FILTER (metric = 'net_bytes_out'), 0.0) AS net_bytes_out"""

_COUNTS_SQL = ", ".join(f"coalesce({c.strip()}, 0) AS {c.strip()}" for c in COUNT_NAMES.split(","))


def _feature_text(df):
    return ops.features_as_text(df).withColumn("timestamp", F.unix_micros("timestamp"))


@query(
    f"""WITH {KERNEL}, {features_sql('hour')}, {histogram_sql('hour')}, {samples_sql('hour')},
wide AS (SELECT node, w, {_GAUGES_SQL} FROM samples GROUP BY ALL),
ids AS (SELECT node, w FROM features UNION SELECT node, w FROM wide)
SELECT epoch_us(w) AS timestamp, 'normal' AS label, node,
  coalesce(avg_cpu, 0.0) AS avg_cpu, coalesce(avg_mem, 0.0) AS avg_mem,
  coalesce(net_bytes_in, 0.0) AS net_bytes_in, coalesce(net_bytes_out, 0.0) AS net_bytes_out,
  {_COUNTS_SQL}, coalesce(h, '{{}}') AS syscall_feature_vector
FROM ids LEFT JOIN features USING (node, w) LEFT JOIN wide USING (node, w)
  LEFT JOIN histogram USING (node, w)"""
)
def assemble_features(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    kernel = parse_kernel_events(ad.kernel_lines(ev))
    return _feature_text(
        ops.assemble_features(
            ad.metric_samples(ev, "1 hour"), ops.event_summary(kernel, "1 hour")
        )
    )


DENSE_SQL = f"""first_seen AS (SELECT node, min(w) AS w0 FROM features GROUP BY node),
grid AS (SELECT node, unnest(generate_series(w0, last_w, INTERVAL 1 DAY)) AS w
  FROM first_seen, last_window),
dense AS (SELECT node, w, {_COUNTS_SQL} FROM grid LEFT JOIN features USING (node, w))"""


@query(
    f"""WITH {KERNEL}, {features_sql('day')},
last_window AS (SELECT max(w) AS last_w FROM features), {DENSE_SQL}
SELECT node, epoch_us(w) AS window_start, {COUNT_NAMES} FROM dense"""
)
def densify(spark, sf_dir):
    out = ops.densify(ops.event_features(_kernel(spark, sf_dir), "1 day"), "1 day")
    return out.withColumn("window_start", F.unix_micros("window_start"))


_DATASET_SQL = f"""{KERNEL}, {features_sql('day')}, {histogram_sql('day')}, {samples_sql('day')},
last_window AS (SELECT max(w) AS last_w FROM (SELECT w FROM features UNION ALL SELECT w FROM samples)),
{DENSE_SQL},
wide AS (SELECT node, w, {_GAUGES_SQL} FROM samples GROUP BY ALL),
ids AS (SELECT node, w FROM dense UNION SELECT node, w FROM wide),
dataset AS (SELECT w, node,
  coalesce(avg_cpu, 0.0) AS avg_cpu, coalesce(avg_mem, 0.0) AS avg_mem,
  coalesce(net_bytes_in, 0.0) AS net_bytes_in, coalesce(net_bytes_out, 0.0) AS net_bytes_out,
  {_COUNTS_SQL}, coalesce(h, '{{}}') AS syscall_feature_vector
  FROM ids LEFT JOIN dense USING (node, w) LEFT JOIN wide USING (node, w)
    LEFT JOIN histogram USING (node, w))"""


def _dataset(ev):
    kernel = parse_kernel_events(ad.kernel_lines(ev))
    return build_features(kernel, ad.metric_samples(ev, "1 day"), "1 day")


@query(
    f"""WITH {_DATASET_SQL} SELECT epoch_us(w) AS timestamp, 'normal' AS label,
  * EXCLUDE (w) FROM dataset"""
)
def feature_dataset(spark, sf_dir):
    return _feature_text(_dataset(ad.events(spark, sf_dir)))


# --------------------------------------------------------------------------- metric vectors


@query(
    f"""WITH {E}, {samples_sql('hour')},
cpu AS (SELECT node, w, value FROM samples WHERE metric = 'avg_cpu'),
mem AS (SELECT node, w, value FROM samples WHERE metric = 'avg_mem'),
nin AS (SELECT node, w, value AS net_in FROM samples WHERE metric = 'net_bytes_in'),
nout AS (SELECT node, w, value AS net_out FROM samples WHERE metric = 'net_bytes_out'),
base AS (SELECT node, w, cpu.value AS cpu, mem.value AS mem
  FROM cpu FULL JOIN mem USING (node, w))
SELECT node, epoch_us(w) AS window_start, coalesce(cpu, 0.0) AS cpu, coalesce(mem, 0.0) AS mem,
  coalesce(net_in, 0.0) AS net_in, coalesce(net_out, 0.0) AS net_out
FROM base LEFT JOIN nin USING (node, w) LEFT JOIN nout USING (node, w)"""
)
def align_vectors(spark, sf_dir):
    samples = ad.metric_samples(ad.events(spark, sf_dir), "1 hour")
    parts = [samples.where(F.col("metric") == m) for m in ops.NODE_GAUGES]
    out = vec.align_vectors(*parts, keys=["node", "window_start"])
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query(
    f"""WITH {E}, {samples_sql('day')}, wide AS (
  SELECT node, w, max(value) FILTER (metric = 'avg_cpu') AS f,
    max(value) FILTER (metric = 'avg_mem') AS b, max(value) FILTER (metric = 'net_bytes_in') AS c,
    max(value) FILTER (metric = 'net_bytes_out') AS t FROM samples GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start, round(100 * (1 - (f + b + c) / t), 6) AS value
FROM wide WHERE (f + b + c) / t IS NOT NULL"""
)
def combine_vectors(spark, sf_dir):
    samples = ad.metric_samples(ad.events(spark, sf_dir), "1 day")
    names = ("mem_free", "mem_buffers", "mem_cached", "mem_total")
    named = samples.replace(dict(zip(ops.NODE_GAUGES, names)), subset=["metric"])
    out = vec.combine_vectors(
        named, names, vec.memory_used_percent(), keys=["node", "window_start"]
    )
    return out.select("node", micros("window_start"), r6("value"))


@query(
    f"""WITH {E}, {samples_sql('day')}, wide AS (
  SELECT node, w, max(value) FILTER (metric = 'avg_cpu') AS a,
    max(value) FILTER (metric = 'avg_mem') AS t FROM samples GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start, round(1 - a / t, 6) AS value FROM wide
WHERE a / t IS NOT NULL"""
)
def memory_used_share(spark, sf_dir):
    samples = ad.metric_samples(ad.events(spark, sf_dir), "1 day")
    named = samples.replace(
        {"avg_cpu": "mem_available", "avg_mem": "mem_total"}, subset=["metric"]
    )
    names = ("mem_available", "mem_total")
    out = vec.combine_vectors(named, names, vec.memory_used_share(), keys=["node", "window_start"])
    return out.select("node", micros("window_start"), r6("value"))


@query(
    f"""WITH {E}, sub AS (SELECT node, date_trunc('day', ts) AS w, k % 8 AS core,
  max(value) / 1000 AS value FROM e GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start, round(100 - 100 * avg(value), 6) AS value
FROM sub GROUP BY ALL"""
)
def cpu_used(spark, sf_dir):
    idle = (
        ad.events(spark, sf_dir)
        .groupBy("node", F.date_trunc("day", "ts").alias("window_start"), (F.col("k") % 8).alias("core"))
        .agg((F.max("value") / 1000).alias("value"))
    )
    used = vec.cpu_used(idle, 100.0, keys=["node", "window_start"])
    return used.select("node", micros("window_start"), r6("value"))


@query(
    f"""WITH {E}, sub AS (SELECT node, date_trunc('day', ts) AS w, k % 8 AS core,
  max(value) AS value FROM e GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start, round(avg(value), 6) AS avg_value,
  round(sum(value), 6) AS sum_value FROM sub GROUP BY ALL"""
)
def by_instance(spark, sf_dir):
    sub = (
        ad.events(spark, sf_dir)
        .groupBy("node", F.date_trunc("day", "ts").alias("window_start"), (F.col("k") % 8).alias("core"))
        .agg(F.max("value").alias("value"))
    )
    both = vec.by_instance(sub, ("avg", "sum"), ["node", "window_start"])
    return both.select("node", micros("window_start"), r6("avg_value"), r6("sum_value"))


@query(
    f"""WITH {E}, ok AS (SELECT *, date_trunc('hour', ts) AS w FROM e
  WHERE event_id % 37 NOT IN (2, 3, 4)),
vals AS (SELECT w, event_type, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE node || ':9100' END
  AS instance, value, event_id FROM ok
  UNION ALL SELECT w, event_type, 'spare:9100', CAST(k AS DOUBLE), event_id FROM ok),
m AS (SELECT event_id, instance, value, CASE event_type WHEN 'click' THEN 'cpu'
  WHEN 'view' THEN 'mem' WHEN 'purchase' THEN 'net_in' WHEN 'signup' THEN 'net_out' END AS metric
  FROM vals)
SELECT event_id AS tick, instance,
  coalesce(max(value) FILTER (metric = 'cpu'), 0.0) AS cpu,
  coalesce(max(value) FILTER (metric = 'mem'), 0.0) AS mem,
  coalesce(max(value) FILTER (metric = 'net_in'), 0.0) AS net_in,
  coalesce(max(value) FILTER (metric = 'net_out'), 0.0) AS net_out
FROM m WHERE metric IS NOT NULL GROUP BY ALL
HAVING count(*) FILTER (metric IN ('cpu', 'mem')) > 0"""
)
def collect_v2(spark, sf_dir):
    metric = (
        F.when(F.col("event_type") == "click", "cpu")
        .when(F.col("event_type") == "view", "mem")
        .when(F.col("event_type") == "purchase", "net_in")
        .when(F.col("event_type") == "signup", "net_out")
    )
    payloads = ad.instant_payloads(ad.events(spark, sf_dir)).select(
        F.col("event_id").alias("tick"), metric.alias("metric"), "payload"
    )
    return metric_rows_v2(payloads, "tick")


# -------------------------------------------------------------------------------- labeling

_LABELS_SQL = f"""{E},
w AS (SELECT event_id AS pos, us // 1000000 + 10 AS s, us // 1000000 + 3600 + 15 AS t,
  'scenario_' || (event_id % 7) AS label FROM e WHERE event_type = 'signup'),
labeled AS (SELECT e.event_id, coalesce(min_by(w.label, w.pos), 'normal') AS label
  FROM e LEFT JOIN w ON e.us // 1000000 BETWEEN w.s AND w.t GROUP BY e.event_id)"""


def _labeled(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    rows = ev.select("event_id", F.unix_timestamp("ts").alias("epoch"))
    return label_rows(rows, ad.scenario_windows(ev))


@query(f"WITH {_LABELS_SQL} SELECT event_id, label FROM labeled")
def label_by_windows(spark, sf_dir):
    return _labeled(spark, sf_dir).select("event_id", "label")


@query(
    f"""WITH {_LABELS_SQL} SELECT count(*) AS total_rows,
  count(*) FILTER (label <> 'normal') AS anomalous_rows FROM labeled"""
)
def label_totals(spark, sf_dir):
    return totals_of_labels(_labeled(spark, sf_dir))


_FEW_SQL = """span AS (SELECT min(us // 1000000) AS a, max(us // 1000000) AS b FROM e),
fw AS (SELECT pos, a + pos * ((b - a) // 9) + 10 AS s, a + (pos + 1) * ((b - a) // 9) - 600 + 15 AS t,
  CASE WHEN pos % 4 = 0 THEN 'normal' ELSE 'scenario_' || pos END AS label
  FROM span, unnest(range(9)) AS r(pos))"""


@query(
    f"""WITH {_DATASET_SQL}, {_FEW_SQL}
SELECT epoch_us(w) AS timestamp, coalesce(min_by(fw.label, pos), 'normal') AS label,
  dataset.* EXCLUDE (w)
FROM dataset LEFT JOIN fw ON epoch_us(w) // 1000000 BETWEEN s AND t
GROUP BY ALL"""
)
def labeled_dataset(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    return _feature_text(label_dataset(_dataset(ev), ad.few_windows(ev)))


# --------------------------------------------------------------------------------- scalars


@query(
    f"""WITH {E} SELECT event_id, node AS host,
  CASE WHEN k % 3 = 0 THEN 'baseline' ELSE 'w' || k || '.yaml' END AS workload,
  printf('%-10s %-8s|', node, printf('%.1f', value)) AS line,
  CASE event_type WHEN 'error' THEN 'BANNED' WHEN 'click' THEN 'PROBATION'
    WHEN 'view' THEN 'COMPROMISED' ELSE 'HEALTHY' END AS tile FROM e"""
)
def scalars_text(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "error", "Banned")
        .when(F.col("event_type") == "click", "Probation")
        .when(F.col("event_type") == "view", "Compromised")
        .otherwise("Healthy")
    )
    path = F.when(
        F.col("k") % 3 != 0,
        F.concat(F.lit("/opt/w/w"), F.col("k").cast("string"), F.lit(".yaml")),
    )
    cells = [F.col("node"), S.fixed_decimals(F.col("value"), 1)]
    return ad.events(spark, sf_dir).select(
        "event_id",
        S.host_of(F.concat("node", F.lit(":9100"))).alias("host"),
        S.basename_or(path).alias("workload"),
        F.concat(S.fixed_width(cells, [10, 8]), F.lit("|")).alias("line"),
        S.status_tile(status).alias("tile"),
    )


@query(
    f"""WITH {E} SELECT event_id, us // 1000000 AS epoch,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
  us AS parsed FROM e"""
)
def scalars_time(spark, sf_dir):
    ts = F.col("ts")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return ad.events(spark, sf_dir).select(
        "event_id",
        S.epoch_seconds(ts).alias("epoch"),
        S.render_time(S.epoch_seconds(ts).cast("double")).alias("text"),
        S.render_iso(F.unix_micros(ts) / 1_000_000).alias("iso"),
        F.unix_micros(S.parse_iso(iso)).alias("parsed"),
    )


@query(
    f"""WITH {E} SELECT event_id, CASE WHEN k = 0 THEN 'unknown' ELSE event_type END AS first_key,
  '{{"' || event_type || '":' || k || ',"z":' || event_id || '}}' AS map_text FROM e"""
)
def scalars_json(spark, sf_dir):
    raw = F.when(F.col("k") == 0, "{}").otherwise(
        F.concat(F.lit('{"'), F.col("event_type"), F.lit('": 1, "a": {"b": 2}}'))
    )
    counts = F.create_map(
        F.lit("z"), F.col("event_id"), F.col("event_type"), F.col("k").cast("bigint")
    )
    return ad.events(spark, sf_dir).select(
        "event_id", S.first_json_key(raw).alias("first_key"), S.map_json(counts).alias("map_text")
    )


@query(
    f"""WITH {E} SELECT event_id, greatest(0.0, least(100.0, value - 20)) AS clamped,
  CAST(greatest(0, least(100, trunc(value))) AS INTEGER) AS progress,
  round(100 - k / 100.0 * 100, 6) AS used_percent, round(1 - k / 100.0, 6) AS used_share,
  CASE WHEN k % 5 = 0 THEN 100.0 ELSE value END AS score,
  CASE WHEN k % 2 = 0 THEN -1.0 ELSE value END AS latency_kept,
  CASE WHEN k % 2 = 0 THEN NULL ELSE value END AS latency_null FROM e"""
)
def scalars_numeric(spark, sf_dir):
    value, k = F.col("value"), F.col("k")
    latency = F.when(k % 2 == 0, F.lit(-1.0)).otherwise(value)
    return ad.events(spark, sf_dir).select(
        "event_id",
        S.clamp(value - 20, 0.0, 100.0).alias("clamped"),
        S.progress(value).alias("progress"),
        r6(S.utilization(k / 100.0, 100.0), "used_percent"),
        r6(S.utilization(k / 100.0), "used_share"),
        S.default_to(F.when(k % 5 != 0, value), 100.0).alias("score"),
        S.latency_or_null(latency).alias("latency_kept"),
        S.latency_or_null(latency, keep_sentinel=False).alias("latency_null"),
    )
