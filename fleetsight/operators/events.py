"""Kernel events -> per-node window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.scalars import is_mining_port, is_tmp_exec, map_json
from fleetsight.plans.grids import explode_steps, width_micros
from fleetsight.schemas import EVENT_COUNTS, NODE_GAUGES

WINDOW = "10 seconds"


def feature_aggregates() -> dict[str, Column]:
    """Counts of one (node, window) group, distinct processes aside."""
    is_exec = F.col("event_class") == "exec"
    is_connect = F.col("event_class") == "connect"
    mining_hits = F.size(F.filter("dports", is_mining_port))
    return {
        "exec_count": F.count_if(is_exec),
        "tmp_exec_count": F.count_if(is_exec & is_tmp_exec(F.col("binary"))),
        "outbound_connect_count": F.count_if(is_connect),
        # one hit per matching argument, not per event
        "mining_port_count": F.sum(F.when(is_connect, mining_hits).otherwise(0)).cast("bigint"),
    }


def event_features(events: DataFrame, window: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Counts per (node, window). The distinct count is exact: Spark first groups by
    (node, window, binary), which spreads a busy node over all tasks."""
    is_exec = F.col("event_class") == "exec"
    aggs = feature_aggregates()
    aggs["unique_process_count"] = F.count_distinct(F.when(is_exec, F.col("binary")))
    return (
        events.groupBy("node", F.window(ts, window).alias("w"))
        .agg(*[aggs[c].alias(c) for c in EVENT_COUNTS])
        .select("node", F.col("w.start").alias("window_start"), *EVENT_COUNTS)
    )


def event_kind_counts(events: DataFrame, window: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Histogram rows (node, window_start, kind, n). Events that failed to parse have no kind."""
    return (
        events.where(F.col("event_class").isNotNull())
        .groupBy("node", F.window(ts, window).alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("node", F.col("w.start").alias("window_start"), "kind", "n")
    )


def event_histogram(events: DataFrame, window: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Event-kind histogram per (node, window) as a map; counted before it is gathered, so a
    group holds one entry per kind."""
    return (
        event_kind_counts(events, window, ts)
        .groupBy("node", "window_start")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias(
                "syscall_feature_vector"
            )
        )
    )


def event_summary(events: DataFrame, window: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Counts and histogram map per (node, window) from one pass over the events.

    Grouping sets count by binary (rows with each distinct binary once) and by kind side by side;
    the second grouping then sums the former and gathers the latter, one entry per kind.
    """
    is_exec = F.col("event_class") == "exec"
    aggs = feature_aggregates()
    base = events.select(
        "node",
        F.window(ts, window)["start"].alias("window_start"),
        F.when(is_exec, F.col("binary")).alias("_binary"),
        "kind",
        "event_class",
        "binary",
        "dports",
    )
    by = [F.col(c) for c in ("node", "window_start", "_binary", "kind")]
    sets = base.groupingSets([by[:3], [by[0], by[1], by[3]]], *by).agg(
        F.grouping("kind").alias("_by_binary"),
        F.count_if(F.col("event_class").isNotNull()).alias("_n"),
        *[a.alias(n) for n, a in aggs.items()],
    )
    of_binary, of_kind = F.col("_by_binary") == 1, F.col("_by_binary") == 0
    entry = F.when(of_kind & (F.col("_n") > 0), F.struct("kind", F.col("_n").alias("n")))
    sums = {n: F.coalesce(F.sum(F.when(of_binary, F.col(n))), F.lit(0)) for n in aggs}
    sums["unique_process_count"] = F.count(F.when(of_binary, F.col("_binary")))
    return sets.groupBy("node", "window_start").agg(
        *[sums[c].alias(c) for c in EVENT_COUNTS],
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("syscall_feature_vector"),
    )


def known_nodes(*frames: DataFrame, node: str = "node") -> DataFrame:
    """Distinct node names over all inputs."""
    out = frames[0].select(node)
    for f in frames[1:]:
        out = out.unionByName(f.select(node))
    return out.distinct()


def assemble_features(
    metrics: DataFrame,
    features: DataFrame,
    label: str = "normal",
    gauges: Sequence[str] = NODE_GAUGES,
) -> DataFrame:
    """Full outer match of metric samples and event features on (node, window_start).

    ``metrics`` is long: (node, window_start, metric, value); ``features`` as given by
    ``event_summary``. Both are unioned into one sparse frame and grouped once: one shuffle with
    map-side combine, no outer-join chain.
    """
    empty_map = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<bigint>")
    )
    sparse = metrics.select("node", "window_start", "metric", "value").unionByName(
        features, allowMissingColumns=True
    )
    return (
        sparse.groupBy("node", "window_start")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("metric") == g, F.col("value"))), F.lit(0.0)).alias(g)
                for g in gauges
            ],
            *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in EVENT_COUNTS],
            F.coalesce(
                # one row per group carries the map
                F.first("syscall_feature_vector", ignorenulls=True), empty_map
            ).alias("syscall_feature_vector"),
        )
        .select(
            F.col("window_start").alias("timestamp"),
            F.lit(label).alias("label"),
            "node",
            *gauges,
            *EVENT_COUNTS,
            "syscall_feature_vector",
        )
    )


def densify(
    df: DataFrame,
    window: str = WINDOW,
    key: str = "node",
    ts: str = "window_start",
    fill: Sequence[str] = EVENT_COUNTS,
    end: DataFrame | None = None,
) -> DataFrame:
    """Zero rows for silent keys: every key, from its first window to the last window overall.

    The grid has one row per key and window, spread by the join key, so no key is gathered.
    ``end``: optional one-row frame (``last_window``) for the closing window.
    """
    first = df.groupBy(key).agg(F.min(ts).alias("_from"))
    last = end if end is not None else df.agg(F.max(ts).alias("last_window"))
    bounds = first.crossJoin(F.broadcast(last)).select(key, "_from", "last_window")
    grid = explode_steps(bounds, "_from", "last_window", width_micros(window), ts).select(key, ts)
    return grid.join(df, [key, ts], "left").select(
        *[
            F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
            if c in fill
            else F.col(c)
            for c in df.columns
        ]
    )


def features_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("syscall_feature_vector", map_json(F.col("syscall_feature_vector")))
