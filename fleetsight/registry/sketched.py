"""Queries: recalibration from stored sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators import sketches as sk
from fleetsight.registry.base import E, query, r6
from fleetsight.registry.models import _workspace

_LN = sk._log_gamma(sk.ALPHA)
_QUANTILES = {"q01": 0.01, "q50": 0.5, "q99": 0.99}
_AT = ", ".join(f"min(slot) FILTER (upto > floor({p} * (n_all - 1))) AS {q}" for q, p in _QUANTILES.items())
_VALUES = ", ".join(
    f"round(greatest(low, least(high, CASE WHEN {q} = 0 THEN 0 ELSE exp(({q} - 1000000) * {_LN!r}::DOUBLE) * {1 - sk.ALPHA} END)), 6) AS {q}"
    for q in _QUANTILES
)


@query(
    f"""WITH {E}, span AS (SELECT *, k || '/' || node AS item FROM e
  WHERE date_trunc('day', ts) >= (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY FROM e)),
m AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high
  FROM span GROUP BY ALL),
b AS (SELECT event_type, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(value) / {_LN!r}::DOUBLE)::BIGINT + 1000000 END AS slot, count(*) AS c
  FROM span GROUP BY ALL),
u AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY slot) AS upto, sum(c) OVER (PARTITION BY event_type) AS n_all FROM b),
q AS (SELECT event_type, {_AT} FROM u GROUP BY ALL),
h AS (SELECT DISTINCT event_type, ('0x' || md5(item)[1:15])::BIGINT AS x FROM span),
k AS (SELECT event_type, count(*) AS m, max(x) AS kth FROM (
  SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY x) <= {sk.SMALLEST}) GROUP BY ALL)
SELECT event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean + 3 * std, 6) AS threshold, {_VALUES},
  CASE WHEN m < {sk.SMALLEST} THEN m ELSE round({sk.SMALLEST - 1}::DOUBLE * {float(1 << sk.HASH_BITS)!r}::DOUBLE / kth)::BIGINT END AS distinct_items
FROM m JOIN q USING (event_type) JOIN k USING (event_type)"""
)
def sketched_recalibration(spark, sf_dir):
    """Thresholds, quantiles and distinct items of a span, from hourly sketches that were stored and rolled up."""
    path = f"{_workspace(spark)}/sketches"
    ev = ad.events(spark, sf_dir).withColumn("item", F.concat_ws("/", "k", "node"))
    sk.sketch_windows(ev, "value", "item", ["event_type"], "1 hour").write.parquet(path)
    daily = sk.roll_up(spark.read.parquet(path), "1 day", ["event_type"])
    first = ev.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    span = sk.span_of(daily, F.lit(first) + F.expr("INTERVAL 3 DAYS"), F.lit("9999-01-01").cast("timestamp"))
    out = sk.recalibrated(span, _QUANTILES, ["event_type"]).withColumnRenamed("distinct", "distinct_items")
    return out.select("event_type", "n", *[r6(c) for c in ("mean", "std", "threshold", *_QUANTILES)], "distinct_items")
