"""Queries: rates, as-of values, sequences, trust, scaling and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.functions.signing import keyed_sha256
from fleetsight.operators import predicates as pred
from fleetsight.operators import scaling as sc
from fleetsight.operators import timeseries as tser
from fleetsight.operators import trust as tr
from fleetsight.operators.reconstruct import sequence_mae as mae_of
from fleetsight.registry.base import (
    COUNTERS,
    LATEST,
    TRANSITIONS,
    E,
    micros,
    query,
    r6,
    steps_text,
    trust_sql,
)
from fleetsight.registry.features import SECRET
from fleetsight.sinks.tables import actions_table as actions_of
from fleetsight.sinks.tables import detection_report as report_of

DAY = 86_400

# ----------------------------------------------------------------------- rates and lookups


@query(
    f"""WITH {COUNTERS}, f AS (SELECT *,
  first_value(us) OVER r AS us0, first_value(grown) OVER r AS grown0 FROM g
  WINDOW r AS (PARTITION BY node ORDER BY us RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW))
SELECT node, us AS ts, value,
  CASE WHEN us > us0 THEN round((grown - grown0) / ((us - us0) / 1000000), 6) END AS rate FROM f"""
)
def counter_rate(spark, sf_dir):
    out = tser.counter_rate(ad.counters(ad.events(spark, sf_dir)), DAY, key=["node"])
    return out.select("node", micros("ts"), "value", r6("rate"))


@query(
    f"""WITH {COUNTERS}, f AS (SELECT *, lag(us) OVER w AS us0, lag(value) OVER w AS v0 FROM g
  WINDOW w AS (PARTITION BY node ORDER BY us))
SELECT node, us AS ts, value, CASE WHEN us - us0 <= 43200000000 THEN
  round((CASE WHEN value < v0 THEN value ELSE value - v0 END) / ((us - us0) / 1000000), 6) END
  AS rate FROM f"""
)
def instant_rate(spark, sf_dir):
    out = tser.instant_rate(ad.counters(ad.events(spark, sf_dir)), DAY / 2, key=["node"])
    return out.select("node", micros("ts"), "value", r6("rate"))


def _ticks(ev, step_s):
    day = F.date_trunc("day", "ts")
    bounds = ev.groupBy("node").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return tser.eval_grid(bounds, step_s)


_TICKS_SQL = """ticks AS (SELECT node, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS tick_ts
  FROM (SELECT node, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b
        FROM e GROUP BY node)),
tk AS (SELECT node, epoch_us(tick_ts) AS tick FROM ticks)"""


@query(
    f"""WITH {COUNTERS}, {_TICKS_SQL}, b AS (
  SELECT tk.node, tick, min_by(grown, us) AS g0, min(us) AS us0, max_by(grown, us) AS g1,
    max(us) AS us1
  FROM tk LEFT JOIN g ON g.node = tk.node AND us BETWEEN tick - {DAY}000000 AND tick
  GROUP BY ALL)
SELECT node, tick, CASE WHEN us1 > us0 THEN round((g1 - g0) / ((us1 - us0) / 1000000), 6) END
  AS rate FROM b"""
)
def eval_grid(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    out = tser.rate_at_ticks(ad.counters(ev), _ticks(ev, 21_600), DAY, key=["node"])
    return out.select("node", micros("tick"), r6("rate"))


@query(
    f"""WITH {E}, {_TICKS_SQL}
SELECT tk.node, tick, CASE WHEN tick - us <= 43200000000 THEN us END AS sample_ts,
  CASE WHEN tick - us <= 43200000000 THEN value END AS value
FROM tk ASOF LEFT JOIN e ON tk.node = e.node AND tick >= us"""
)
def asof_latest(spark, sf_dir):
    ev = ad.events(spark, sf_dir)
    samples = ev.select("node", "ts", "value")
    out = tser.asof_latest(samples, _ticks(ev, 21_600), DAY / 2, key=["node"])
    return out.select("node", micros("tick"), micros("sample_ts"), "value")


# ------------------------------------------------------------------------------- sequences


def _points(ev):
    return ev.select("node", "ts", "event_id", "value", F.col("k").cast("double").alias("k"))


_STEP_SQL = "CAST(round(value * 100) AS BIGINT) || ',' || CAST(k * 100 AS BIGINT)"
_SEQ_SQL = f"""{E}, seqs AS (SELECT node, event_id, us,
  string_agg({_STEP_SQL}, ';') OVER w AS seq,
  lead(1, 10) OVER (PARTITION BY node ORDER BY us) AS more FROM e
  WINDOW w AS (PARTITION BY node ORDER BY us ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))"""


@query(f"WITH {_SEQ_SQL} SELECT node, event_id, seq FROM seqs WHERE more = 1")
def make_sequences(spark, sf_dir):
    out = tser.make_sequences(
        _points(ad.events(spark, sf_dir)), ["value", "k"], 10, by=["node"], keep=["event_id"]
    )
    return out.select("node", "event_id", steps_text("seq").alias("seq"))


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY us DESC) AS rn FROM e)
SELECT node, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn DESC) AS events
FROM r WHERE rn <= 10 GROUP BY node"""
)
def last_n(spark, sf_dir):
    out = tser.last_n(ad.events(spark, sf_dir), ["node"], 10, ["event_id"])
    ids = F.transform("rows", lambda r: r["event_id"].cast("string"))
    return out.select("node", F.array_join(ids, ",").alias("events"))


@query(
    f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY node, event_type ORDER BY us DESC)
  AS rn FROM e WHERE event_type <> 'error'),
s AS (SELECT node, rn, count(*) AS n,
  CAST(round(max(value) FILTER (event_type = 'click') * 100) AS BIGINT) || ',' ||
  CAST(round(max(value) FILTER (event_type = 'view') * 100) AS BIGINT) || ',' ||
  CAST(round(max(value) FILTER (event_type = 'purchase') * 100) AS BIGINT) || ',' ||
  CAST(round(max(value) FILTER (event_type = 'signup') * 100) AS BIGINT) AS step
  FROM r WHERE rn <= 10 GROUP BY ALL)
SELECT node, string_agg(step, ';' ORDER BY rn DESC) AS seq FROM s WHERE n = 4
GROUP BY node HAVING count(*) = 10"""
)
def align_last_n(spark, sf_dir):
    series = ad.events(spark, sf_dir).withColumnRenamed("event_type", "metric")
    out = tser.align_last_n(series, 10, metrics=("click", "view", "purchase", "signup"))
    return out.select("node", steps_text("seq").alias("seq"))


@query(
    f"""WITH {E}, s AS (SELECT node, event_id, us, list(value) OVER w AS v, list(k) OVER w AS ks,
  lead(1, 10) OVER (PARTITION BY node ORDER BY us) AS more FROM e
  WINDOW w AS (PARTITION BY node ORDER BY us ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT node, event_id, round((
  list_sum([abs(v[i] - v[11 - i]) FOR i IN range(1, 11)])
  + list_sum([abs(ks[i] - ks[11 - i]) FOR i IN range(1, 11)])) / 20, 6) AS mae
FROM s WHERE more = 1"""
)
def sequence_mae(spark, sf_dir):
    seqs = tser.make_sequences(
        _points(ad.events(spark, sf_dir)), ["value", "k"], 10, by=["node"], keep=["event_id"]
    )
    out = mae_of(seqs.withColumn("mirror", F.reverse("seq")), "seq", "mirror")
    return out.select("node", "event_id", r6("mae"))


@query(
    f"""WITH {E} SELECT node, row_number() OVER (PARTITION BY node ORDER BY us) - 1 AS time_step,
  value AS cpu, k AS score, 5.0::DOUBLE AS cpu_line,
  0.08::DOUBLE AS score_line FROM e"""
)
def series_for_plot(spark, sf_dir):
    ev = ad.events(spark, sf_dir).withColumnsRenamed({"value": "cpu", "k": "score"})
    return tser.series_for_plot(ev)


@query(
    f"""WITH {E} SELECT node, row_number() OVER (ORDER BY us, event_id) - 1 AS time_step,
  value AS cpu, round(value / 1000 - 0.2, 6) AS score FROM e"""
)
def plot_series(spark, sf_dir):
    ev = ad.events(spark, sf_dir).select(
        "node", "ts", "event_id", F.col("value").alias("cpu"),
        r6(F.col("value") / 1000 - 0.2, "score"),
    )
    out = tser.series_for_plot(ev, order=("ts", "event_id"), global_index=True)
    return out.select("node", "time_step", "cpu", "score")


# ------------------------------------------------------------------------------------ trust

ORDER = ("ts", "event_id")


# An Arrow stage reads every column it is given, so only the needed ones go in.
STEP = ("node", *ORDER, "is_anomaly")


def _records(spark, sf_dir):
    return ad.records(ad.events(spark, sf_dir))


@query(f"WITH {trust_sql(15.0, 2.0)} SELECT node, event_id, score FROM scored")
def trust_v1(spark, sf_dir):
    out = tr.trust_scores(_records(spark, sf_dir).select(*STEP), tr.V1, order=ORDER)
    return out.select("node", "event_id", "score")


@query(f"WITH {trust_sql(5.0, 1.0)} SELECT node, event_id, score FROM scored")
def trust_v2(spark, sf_dir):
    out = tr.trust_scores(_records(spark, sf_dir).select(*STEP), tr.V2, order=ORDER)
    return out.select("node", "event_id", "score")


def _transitions(spark, sf_dir):
    scored = tr.trust_scores(_records(spark, sf_dir), tr.V1, order=ORDER, tampered="tampered")
    return tr.status_transitions(scored, "tampered")


@query(
    f"WITH {TRANSITIONS} SELECT node, event_id, score, prev_status, status, action FROM acted"
)
def status_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir).select(
        "node", "event_id", "score", "prev_status", "status", "action"
    )


@query(
    f"WITH {TRANSITIONS} SELECT node, us AS ts, action FROM acted WHERE action IS NOT NULL"
)
def actions_table(spark, sf_dir):
    return actions_of(_transitions(spark, sf_dir)).withColumn("ts", F.unix_micros("ts"))


@query(
    f"""WITH {E} SELECT node, event_id,
  bool_or(event_id % 97 = 0) OVER (PARTITION BY node ORDER BY us, event_id) AS compromised FROM e"""
)
def latch(spark, sf_dir):
    out = tr.latch(_records(spark, sf_dir), "tampered", order=ORDER)
    return out.select("node", "event_id", "compromised")


@query(
    f"""WITH {trust_sql(15.0, 2.0)}, marks AS (SELECT *, CASE WHEN score < 40 THEN 1
  WHEN score > 60 THEN 0 END AS mark FROM scored),
held AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY node
  ORDER BY us, event_id), 0) AS flag FROM marks),
edges AS (SELECT *, coalesce(lag(flag) OVER (PARTITION BY node ORDER BY us, event_id), 0) AS before
  FROM held)
SELECT node, event_id, score, flag = 1 AS cordoned,
  CASE WHEN flag > before THEN 'CORDON' WHEN flag < before THEN 'UNCORDON' END AS action
FROM edges"""
)
def hysteresis(spark, sf_dir):
    out = tr.cordon_trace(_records(spark, sf_dir).select(*STEP), tr.V1, order=ORDER)
    return out.select("node", "event_id", "score", "cordoned", "action")


def _state(spark, sf_dir):
    return tr.latest_state(
        _transitions(spark, sf_dir),
        order=ORDER,
        cols=["last_seen", "cpu", "score", "status", "raw_status"],
    )


@query(
    f"""WITH {LATEST} SELECT node, us / 1000000 AS last_seen, cpu, score, status, raw_status
FROM latest"""
)
def latest_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"WITH {LATEST} SELECT node, status FROM latest WHERE status IN ('Banned', 'Probation')")
def bad_nodes(spark, sf_dir):
    return pred.bad_nodes(_state(spark, sf_dir)).select("node", "status")


@query(
    f"""WITH {LATEST} SELECT node, status, CASE status WHEN 'Banned' THEN 'BANNED'
  WHEN 'Probation' THEN 'PROBATION' WHEN 'Compromised' THEN 'COMPROMISED' ELSE 'HEALTHY' END AS tile,
  printf('%.1f', cpu) || '%' AS cpu_text, printf('%.1f', score) AS score_text,
  CAST(score AS INTEGER) AS progress,
  CASE status WHEN 'Banned' THEN 'BANNED (Cordoned/Drained)'
    WHEN 'Probation' THEN 'PROBATION (Tainted)' END AS alert FROM latest"""
)
def node_health(spark, sf_dir):
    return tr.node_health(_state(spark, sf_dir))


@query(
    f"""WITH {LATEST} SELECT node, status, CASE status WHEN 'Banned' THEN 'BANNED (Cordoned/Drained)'
    WHEN 'Probation' THEN 'PROBATION (Tainted)' END AS alert FROM latest
  WHERE status IN ('Banned', 'Probation')"""
)
def node_alerts(spark, sf_dir):
    return tr.node_alerts(_state(spark, sf_dir))


# ------------------------------------------------------------------- scaling and calibration

_FEATS = ad.FOREST_FEATURES


def _items(spark, sf_dir):
    return ad.load(spark, sf_dir, "lineitem").select(
        *ad.FOREST_ID, *_FEATS, F.lit(1.0).alias("l_const")
    )


def _columns(exprs: str) -> str:
    return ", ".join(exprs.format(f=f) for f in _FEATS)


@query(
    "WITH p AS (SELECT "
    + _columns("avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s")
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + _columns("round(({f} - {f}_m) / {f}_s, 6) AS {f}")
    + ", 0.0::DOUBLE AS l_const FROM lineitem, p"
)
def standard_scale(spark, sf_dir):
    cols = [*_FEATS, "l_const"]
    out = sc.standard_scale(_items(spark, sf_dir), cols)
    return out.select("l_orderkey", "l_linenumber", *[r6(c) for c in cols])


@query(
    "WITH p AS (SELECT "
    + _columns("min({f}) AS {f}_a, max({f}) AS {f}_b")
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + _columns("round(({f} - {f}_a) / ({f}_b - {f}_a), 6) AS {f}")
    + ", 0.0::DOUBLE AS l_const FROM lineitem, p"
)
def minmax_scale(spark, sf_dir):
    cols = [*_FEATS, "l_const"]
    out = sc.minmax_scale(_items(spark, sf_dir), cols)
    return out.select("l_orderkey", "l_linenumber", *[r6(c) for c in cols])


@query(
    "SELECT "
    + _columns("round(avg({f}), 6) AS {f}_mean, round(stddev_pop({f}), 6) AS {f}_std")
    + " FROM lineitem"
)
def fit_standard(spark, sf_dir):
    out = sc.fit_standard(_items(spark, sf_dir), _FEATS)
    return out.select(*[r6(c) for c in out.columns])


@query("SELECT " + _columns("min({f}) AS {f}_min, max({f}) AS {f}_max") + " FROM lineitem")
def fit_minmax(spark, sf_dir):
    return sc.fit_minmax(_items(spark, sf_dir), _FEATS)


@query(
    """SELECT round(avg(value), 6) AS mean_loss, round(stddev_pop(value), 6) AS std_loss,
  round(avg(value) + 3 * stddev_pop(value), 6) AS threshold FROM events"""
)
def sigma_threshold(spark, sf_dir):
    out = sc.sigma_threshold(ad.events(spark, sf_dir), "value")
    return out.select(*[r6(c) for c in out.columns])


@query(
    """SELECT min(value) AS min_score, max(value) AS max_score, round(avg(value), 6) AS mean_score,
  round(min(value) - 0.05, 6) AS suggested_threshold FROM events"""
)
def score_summary(spark, sf_dir):
    out = sc.score_summary(ad.events(spark, sf_dir), "value")
    return out.select("min_score", "max_score", r6("mean_score"), r6("suggested_threshold"))


@query('SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS "offset" FROM lineitem')
def contamination_offset(spark, sf_dir):
    out = sc.contamination_offset(_items(spark, sf_dir), 0.01, "l_extendedprice")
    return out.select(r6("offset"))


# -------------------------------------------------------------------------------- verdicts

# Scores from the value column; those with k = 13 are NaN.
_LOW_SQL = f"""{E}, v AS (SELECT *, CASE WHEN k <> 13 AND value / 1000 - 0.2 > -0.17
  THEN 'Normal' ELSE 'Anomaly' END AS status FROM e)"""


def _classified(spark, sf_dir):
    score = F.when(F.col("k") == 13, F.lit(float("nan"))).otherwise(F.col("value") / 1000 - 0.2)
    scored = ad.events(spark, sf_dir).withColumn("score", score)
    return pred.classify(scored, "score", -0.17, "low")


@query(
    f"""WITH {_LOW_SQL} SELECT event_id, status AS low_status,
  CASE WHEN k <> 13 AND value / 1000 - 0.2 > -0.1 THEN 'Anomaly' ELSE 'Normal' END AS high_status
FROM v"""
)
def classify(spark, sf_dir):
    low = _classified(spark, sf_dir).withColumnRenamed("status", "low_status")
    high = pred.classify(low, "score", -0.1, "high", out="high_status")
    return high.select("event_id", "low_status", "high_status")


@query(
    f"""WITH {_LOW_SQL} SELECT count(*) AS total_rows,
  count(*) FILTER (status = 'Anomaly') AS anomalies FROM v"""
)
def detection_totals(spark, sf_dir):
    return sc.detection_totals(_classified(spark, sf_dir))


@query(
    f"""WITH {_LOW_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (status = 'Anomaly') AS a
  FROM v), rule AS (SELECT repeat('-', 40) AS d)
SELECT 0 AS section, NULL AS event_id,
  'Node            CPU    Score    Status' || chr(10) || d AS line FROM rule
UNION ALL SELECT 1, event_id,
  printf('%-15s %-6s %-8s %s', node, printf('%.1f', value), printf('%.3f', k / 7), status)
  || CASE WHEN status = 'Anomaly' THEN ' <--- DETECTED' ELSE '' END FROM v
UNION ALL SELECT 2, NULL, d || chr(10) || 'Total Rows: ' || n || chr(10)
  || 'Anomalies Detected: ' || a FROM c, rule"""
)
def detection_report(spark, sf_dir):
    rows = _classified(spark, sf_dir).withColumns(
        {"cpu": F.col("value"), "score": F.col("k") / 7}
    )
    return report_of(rows, ["event_id"])


@query(
    f"""WITH {_LOW_SQL} SELECT event_type AS label, count(*) AS n,
  count(*) FILTER (event_type = 'click' AND status = 'Normal') AS correct_normal,
  count(*) FILTER (event_type = 'click' AND status = 'Anomaly') AS false_positive,
  count(*) FILTER (event_type <> 'click' AND status = 'Anomaly') AS detected,
  count(*) FILTER (event_type <> 'click' AND status = 'Normal') AS missed
FROM v GROUP BY ALL"""
)
def evaluate_verdicts(spark, sf_dir):
    rows = _classified(spark, sf_dir).withColumnRenamed("event_type", "label")
    return sc.evaluate_verdicts(rows, normal="click")


# -------------------------------------------------------------------------------- signatures


@query(
    f"""WITH {E} SELECT event_id,
  sha256(event_id || '|' || event_type || '|' || props || '{SECRET}') AS signature
FROM events"""
)
def sign_records(spark, sf_dir):
    raw = ad.load(spark, sf_dir, "events")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return raw.select("event_id", keyed_sha256(payload, SECRET).alias("signature"))
