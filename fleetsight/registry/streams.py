"""Queries: streams whose input arrives in parts, each run going on from the last one's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight import adapters as ad
from fleetsight.operators import reconstruct as rec
from fleetsight.registry.base import CLAMPED, COUNT_NAMES, KERNEL, TRANSITIONS, E, features_sql, query
from fleetsight.registry.models import _with_rocksdb, _workspace
from fleetsight.sources.lines import parse_kernel_events
from fleetsight.streaming.chain import ALIGN_TABLES, RATE_TABLES, TRUST_TABLES, align_step, detect_v2_step, rate_step
from fleetsight.streaming.labels import LABEL_TABLES, label_input, label_step, labeled_rows
from fleetsight.streaming.late import REVISION_TABLES, dropped_rows, latest_revisions, revision_step
from fleetsight.streaming.run import run_bounded, stream_to_table
from fleetsight.streaming.steps import Step, stream_steps
from fleetsight.streaming.ticks import TICK_TABLES, tick_step
from fleetsight.streaming.trust import TRUST_TABLES as TRUST_STATE
from fleetsight.streaming.trust import trust_step

PARTS = 3


def arrivals(
    spark, sf_dir: str, build: Callable[[DataFrame], DataFrame], parts: int = PARTS, late: Column | None = None
) -> DataFrame:
    """What ``build`` makes of the events as they arrive: in event order, in parts, but ``late`` ones with the
    last part. Each part is a run of its own that takes up the checkpoint of the one before."""
    schemas: list = []

    def start(raw: DataFrame, work: str) -> StreamingQuery:
        stream = build(ad.shape_events(raw))
        schemas.append(stream.schema)
        return stream_to_table(stream, f"{work}/out", f"{work}/checkpoint")

    work = _with_rocksdb(spark, lambda: _in_parts(spark, sf_dir, start, parts, late))
    return spark.read.schema(schemas[-1]).parquet(f"{work}/out")


def arrivals_in_steps(
    spark,
    sf_dir: str,
    build: Callable[[DataFrame], DataFrame],
    step: Step,
    tables: Sequence[str],
    parts: int = PARTS,
    late: Column | None = None,
) -> DataFrame:
    """The same arrivals, each micro-batch of what ``build`` makes of them worked on by ``step``."""

    def start(raw: DataFrame, work: str) -> StreamingQuery:
        return stream_steps(build(ad.shape_events(raw)), step, tables, work, f"{work}/checkpoint")

    work = _in_parts(spark, sf_dir, start, parts, late)
    return spark.read.parquet(f"{work}/out").drop("batch")


def _in_parts(
    spark, sf_dir: str, start: Callable[[DataFrame, str], StreamingQuery], parts: int, late: Column | None
) -> str:
    table = ad.load(spark, sf_dir, "events")
    low, high = table.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - F.lit(low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1))
    if late is not None:
        part = F.when(late, parts - 1).otherwise(part)
    work = _workspace(spark)
    cores = spark.sparkContext.defaultParallelism
    for i in range(parts):
        # a part lies in few splits of the table; as many files as cores, so that reading them is spread
        table.where(part == i).repartition(cores, "event_id").write.parquet(f"{work}/in/p{i}")
        raw = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(f"{work}/in")
        run_bounded(start(raw, work))
    return work


# Scales of the given detector; its bottleneck keeps the first sixteen of forty numbers and replaces the
# others, the newest six steps, by 0.5.
_SCALES = {"cpu": 100.0, "mem": 100.0, "net_in": 1.0, "net_out": 1.0}
_KEPT, _LIMIT, _RANGE_S, _DAY_S = 16, 0.2305, 172_800, 86_400

_ALIGNED_SQL = f"""WITH {E}, r AS (
  SELECT *, us // {_DAY_S * 1_000_000} AS day, lag(us) OVER w AS pus, lag(event_id) OVER w AS pe FROM e
  WINDOW w AS (PARTITION BY node ORDER BY us)),
s AS (
  SELECT node, day, us, 'cpu' AS metric, value / {_SCALES['cpu']}::DOUBLE AS x FROM r
  UNION ALL SELECT node, day, us, 'mem', k::DOUBLE / {_SCALES['mem']}::DOUBLE FROM r
  UNION ALL SELECT node, day, us, m, (event_id - pe) * f / ((us - pus) / 1000000.0::DOUBLE)
    FROM r, (VALUES ('net_in', 7.0::DOUBLE), ('net_out', 3.0::DOUBLE)) AS c(m, f)
    WHERE us - pus <= {_RANGE_S * 1_000_000}),
l AS (
  SELECT node, metric, day, max_by(xs, us) AS xs FROM (
    SELECT *, list(x) OVER (PARTITION BY node, metric ORDER BY us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS xs FROM s)
  GROUP BY ALL),
ticks AS (
  SELECT node, day, metric FROM (SELECT DISTINCT node, day, max(day) OVER (PARTITION BY node) AS last_day FROM r),
    (VALUES ('cpu'), ('mem'), ('net_in'), ('net_out')) AS m(metric) WHERE day < last_day)"""

_CHAIN_SQL = f"""{_ALIGNED_SQL},
a AS (
  SELECT t.node, t.day, sum(list_sum(list_transform(l.xs[5:10], lambda x: abs(x - 0.5)))) / 40 AS loss
  FROM ticks t ASOF JOIN l ON t.node = l.node AND t.metric = l.metric AND t.day >= l.day
  WHERE len(l.xs) = 10 GROUP BY t.node, t.day HAVING count(*) = 4),
v AS (SELECT *, CASE WHEN loss > {_LIMIT} THEN 'Anomaly' ELSE 'Normal' END AS status FROM a),
t AS (
  SELECT *, list_reduce(list(CASE WHEN status = 'Anomaly' THEN -5.0::DOUBLE ELSE 1.0 END) OVER
    (PARTITION BY node ORDER BY day), {CLAMPED}, CAST(100.0 AS DOUBLE)) AS score FROM v),
c AS (
  SELECT *, coalesce(last_value(CASE WHEN score < 40 THEN true WHEN score > 60 THEN false END IGNORE NULLS)
    OVER (PARTITION BY node ORDER BY day), false) AS cordoned FROM t),
p AS (SELECT *, coalesce(lag(cordoned) OVER (PARTITION BY node ORDER BY day), false) AS old FROM c)
SELECT node, (day + 1) * {_DAY_S * 1_000_000} AS tick, round(loss, 6) AS loss, status, score, cordoned,
  CASE WHEN cordoned AND NOT old THEN 'CORDON' WHEN old AND NOT cordoned THEN 'UNCORDON' END AS action
FROM p"""


_RATES_SQL = f"""WITH {E}, r AS (
  SELECT *, lag(us) OVER w AS pus, lag(event_id) OVER w AS pe FROM e WINDOW w AS (PARTITION BY node ORDER BY us))
SELECT node, metric, us, round(x, 6) AS value FROM (
  SELECT node, 'cpu' AS metric, us, value AS x FROM r UNION ALL SELECT node, 'mem', us, k::DOUBLE FROM r
  UNION ALL SELECT node, m, us, (event_id - pe) * f / ((us - pus) / 1000000.0::DOUBLE)
    FROM r, (VALUES ('net_in', 7.0::DOUBLE), ('net_out', 3.0::DOUBLE)) AS c(m, f) WHERE us - pus <= {_RANGE_S * 1_000_000})"""


@query(_RATES_SQL)
def stream_instant_rate(spark, sf_dir):
    """Counters as rates while samples arrive; gauges as they are."""
    found = arrivals_in_steps(spark, sf_dir, ad.chain_samples, rate_step(_RANGE_S), RATE_TABLES)
    return found.withColumn("value", F.round("value", 6))


@query(
    f"""{_ALIGNED_SQL}, m AS (SELECT t.node, t.day, t.metric, l.xs FROM ticks t ASOF JOIN l
  ON t.node = l.node AND t.metric = l.metric AND t.day >= l.day WHERE len(l.xs) = 10),
w AS (SELECT node, day, max(CASE WHEN metric = 'cpu' THEN xs END) AS c, max(CASE WHEN metric = 'mem' THEN xs END) AS k,
  max(CASE WHEN metric = 'net_in' THEN xs END) AS i, max(CASE WHEN metric = 'net_out' THEN xs END) AS o FROM m GROUP BY ALL HAVING count(*) = 4)
SELECT node, (day + 1) * {_DAY_S * 1_000_000} AS tick, step::INTEGER AS step, round(c[step + 1] * 100, 6) AS cpu, round(k[step + 1] * 100, 6) AS mem,
  round(i[step + 1], 6) AS net_in, round(o[step + 1], 6) AS net_out FROM w, (SELECT unnest(range(10)) AS step)"""
)
def stream_align_last_n(spark, sf_dir):
    """The last ten points of four metrics side by side at each day's end, while samples arrive."""
    found = arrivals_in_steps(spark, sf_dir, ad.chain_samples, align_step(_RANGE_S, step_s=_DAY_S), RATE_TABLES + ALIGN_TABLES)
    step = found.select("node", "tick", "flat", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    cells = [F.round(F.col("flat")[F.col("step") * 4 + i], 6).alias(m) for i, m in enumerate(_SCALES)]
    return step.select("node", "tick", "step", *cells)


@query(_CHAIN_SQL)
def stream_detect_v2(spark, sf_dir):
    """Rates, alignment, losses, trust and cordon flags as one stream, with a given bottleneck."""
    model = rec.Reconstruction(np.full(40, 0.5), np.eye(40)[:, :_KEPT])
    scales = [F.lit(x).alias(f"{m}_{end}") for m, top in _SCALES.items() for end, x in (("min", 0.0), ("max", top))]
    scaler = spark.range(1).select(*scales)

    step = detect_v2_step(scaler, model, _LIMIT, _RANGE_S, _DAY_S)
    found = arrivals_in_steps(spark, sf_dir, ad.chain_samples, step, RATE_TABLES + ALIGN_TABLES + TRUST_TABLES)
    return found.withColumn("loss", F.round("loss", 6))


_LATE_KEPT = "kept AS (SELECT p.* FROM parsed p JOIN arrived a USING (event_id) WHERE NOT too_late)"
_LATE_SQL = f"""WITH {KERNEL}, parts AS (
  SELECT parsed.*, epoch_us(date_trunc('day', ts)) AS day_us,
    CASE WHEN event_id % 37 = 5 THEN {PARTS - 1} ELSE (event_id - low) * {PARTS} // (high - low + 1) END AS part
  FROM parsed, (SELECT min(event_id) AS low, max(event_id) AS high FROM e)),
seen AS (SELECT part, max(epoch_us(ts) // 1000) - 10000 AS ms FROM parts GROUP BY part),
arrived AS (
  SELECT event_id, node, date_trunc('day', ts) AS w,
    (day_us + 86400000000) // 1000 + 432000000 <= coalesce((SELECT max(ms) FROM seen WHERE seen.part < parts.part), 0) AS too_late
  FROM parts),
{_LATE_KEPT}, {features_sql('day').replace('FROM parsed', 'FROM kept')},
counted AS (SELECT node, w, count(*) FILTER (NOT too_late) AS counted, count(*) FILTER (too_late) AS dropped FROM arrived GROUP BY ALL)
SELECT node, epoch_us(w) AS window_start,
  {", ".join(f"coalesce({c.strip()}, 0) AS {c.strip()}" for c in COUNT_NAMES.split(","))}, counted, dropped
FROM counted LEFT JOIN features USING (node, w)"""


@query(_LATE_SQL)
def stream_late_windows(spark, sf_dir):
    """Window features with corrections; rows that come days late are counted, not lost."""

    def build(ev):
        return parse_kernel_events(ad.kernel_lines(ev))

    step = revision_step("1 day", keep="5 days")
    revisions = arrivals_in_steps(spark, sf_dir, build, step, REVISION_TABLES, late=F.col("event_id") % 37 == 5)
    both = latest_revisions(revisions, extra=("counted",)).join(dropped_rows(revisions), ["node", "window_start"], "full")
    numbers = [c for c in both.columns if c not in ("node", "window_start")]
    return both.select("node", F.unix_micros("window_start").alias("window_start"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


_BUSY_ROWS = 200_000  # rows of a node from which it is cut
_BUSY = "CASE WHEN event_id % 10 <> 0 THEN 'node-busy' ELSE 'node-' || user_id END AS node"


@query(f"""WITH {TRANSITIONS.replace("'node-' || user_id AS node", _BUSY)} SELECT node, event_id, score, status, action FROM acted""")
def stream_trust_sliced(spark, sf_dir):
    """Trust where one node has nine tenths of the rows."""

    def build(ev):
        return ad.records(ad.busy_node(ev)).select("node", "ts", "event_id", "is_anomaly", "tampered")

    step = trust_step(order=("ts", "event_id"), rows_per_chunk=_BUSY_ROWS)
    return arrivals_in_steps(spark, sf_dir, build, step, TRUST_STATE).select("node", "event_id", "score", "status", "action")


_STEP_S, _WRAP = 21_600, 5_000


def _wrapping(ev: DataFrame) -> DataFrame:
    """Samples whose counters start again every now and then."""
    reset = F.when(F.col("metric").isin("net_in", "net_out"), F.pmod("value", F.lit(float(_WRAP)))).otherwise(F.col("value"))
    return ad.chain_samples(ev).withColumn("value", reset)


_TICKS_SQL = f"""WITH {E}, v AS (
  SELECT node, us, metric, x FROM (
    SELECT node, us, 'cpu' AS metric, value AS x FROM e UNION ALL SELECT node, us, 'mem', k::DOUBLE FROM e
    UNION ALL SELECT node, us, m, (event_id * f % {_WRAP})::DOUBLE FROM e, (VALUES ('net_in', 7), ('net_out', 3)) AS c(m, f))),
s AS (SELECT *, lag(x) OVER (PARTITION BY node, metric ORDER BY us, x) AS before FROM v),
g AS (SELECT *, sum(CASE WHEN before IS NULL THEN 0 WHEN x < before THEN x ELSE x - before END)
  OVER (PARTITION BY node, metric ORDER BY us, x ROWS UNBOUNDED PRECEDING) AS grown FROM s),
h AS (SELECT *, unnest(range((us + {_STEP_S}000000 - 1) // {_STEP_S}000000, (us + {_DAY_S}000000) // {_STEP_S}000000 + 1)) * {_STEP_S}000000 AS tick FROM g),
b AS (SELECT node, metric, tick, min(us) AS us0, max(us) AS us1, min_by(grown, (us, x)) AS g0, max_by(grown, (us, x)) AS g1,
    max_by(x, (us, x)) AS x1 FROM h
  WHERE tick // 1000 <= (SELECT max(us) // 1000 - 10000 FROM e) GROUP BY ALL)
SELECT node, metric, tick, CASE WHEN tick - us1 <= 43200000000 THEN us1 END AS sample_us,
  CASE WHEN tick - us1 <= 43200000000 THEN round(x1, 6) END AS value,
  CASE WHEN metric LIKE 'net%' AND us1 > us0 THEN round((g1 - g0) / ((us1 - us0) / 1000000), 6) END AS rate FROM b"""


@query(_TICKS_SQL)
def stream_ticks(spark, sf_dir):
    """Counter rates over a trailing day and the latest values, every six hours, while samples arrive."""
    found = arrivals_in_steps(spark, sf_dir, _wrapping, tick_step(_STEP_S, _DAY_S, _DAY_S / 2), TICK_TABLES)
    cells = [F.round(c, 6).alias(c) for c in ("value", "rate")]
    return found.select("node", "metric", "tick", "sample_us", *cells)


_LABEL_LAG_S, _LABEL_DELAY_S, _CELL_S = 2 * _DAY_S, 3 * _DAY_S, 3600


def _announced(ev: DataFrame) -> DataFrame:
    """Scenario windows that become known two days after they began."""
    back = {c: F.col(c) - _LABEL_LAG_S for c in ("start_time", "end_time")}
    return ad.scenario_windows(ev).withColumns(back)


_STREAM_LABELS_SQL = f"""WITH {E},
w AS (SELECT event_id AS pos, us // 1000000 - {_LABEL_LAG_S} + 10 AS s, us // 1000000 - {_LABEL_LAG_S} + 3600 + 15 AS t,
  'scenario_' || (event_id % 7) AS label FROM e WHERE event_type = 'signup'),
closed AS (SELECT * FROM e WHERE (us // 1000000 // {_CELL_S} + 1) * {_CELL_S}
  <= (SELECT max(us) // 1000000 - {_LABEL_DELAY_S} FROM e))
SELECT c.event_id, c.node, coalesce(min_by(w.label, w.pos), 'normal') AS label
FROM closed c LEFT JOIN w ON c.us // 1000000 BETWEEN w.s AND w.t GROUP BY c.event_id, c.node"""


@query(_STREAM_LABELS_SQL)
def stream_window_labels(spark, sf_dir):
    """Labels by scenario windows that arrive days after the rows they label."""

    def build(ev):
        rows = ev.select("event_id", "node", F.unix_timestamp("ts").alias("epoch"))
        return label_input(rows, _announced(ev))

    step = label_step(f"{_LABEL_DELAY_S} seconds", _CELL_S)
    return labeled_rows(arrivals_in_steps(spark, sf_dir, build, step, LABEL_TABLES)).select("event_id", "node", "label")
