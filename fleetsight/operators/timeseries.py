"""Rates, as-of lookups, grids, sequences and last-N rows.

Times are timestamps on the surface and epoch microseconds inside. Everything that depends on
row order goes through ``plans.ordered``, so one busy series never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.plans.kept import settled
from fleetsight.plans.ordered import (
    CHUNK,
    HOT,
    OrderedRows,
    following,
    latest,
    ordered,
    position,
    previous,
    total,
)
from fleetsight.plans.grids import explode_steps

_MICROS = 1_000_000
FRAME_ROWS = 50  # samples per range up to which a range frame, which rereads them, is used


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _slope(first: Column, last: Column) -> Column:
    """Counter growth per second between two (t, c) structs; null without two samples."""
    return F.when(
        last["t"] > first["t"], (last["c"] - first["c"]) / ((last["t"] - first["t"]) / _MICROS)
    )


def _with_growth(
    samples: DataFrame, key: Sequence[str], ts: str, value: str, rows_per_chunk: int | None
) -> OrderedRows:
    """Add ``_t`` and ``_c``: the counter with its resets taken out, starting from 0."""
    rows = ordered(
        samples.withColumn("_t", _micros(ts)), key, ["_t"], rows_per_chunk, ties=[value]
    )
    rows = rows.running(_before=previous(F.col(value)))
    if rows.split:  # the next summary and the rows would each run this window again
        rows = replace(rows, df=settled(rows.df))
    step = (
        F.when(F.col("_before").isNull(), F.lit(0).cast(samples.schema[value].dataType))
        .when(F.col(value) < F.col("_before"), F.col(value))
        .otherwise(F.col(value) - F.col("_before"))
    )
    return rows.with_columns(_step=step).running(_c=total(F.col("_step")))


def counter_rate(
    samples: DataFrame,
    range_s: float,
    key: Sequence[str] = ("instance",),
    ts: str = "ts",
    value: str = "value",
    out: str = "rate",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Per-second growth of a counter over the trailing range at each sample.

    Growth is measured from the first to the last sample in the range; after a reset (a smaller
    value) counting goes on from the new value. Null with fewer than two samples in range. Samples
    of one time count in the order of their values.
    """
    rows = _with_growth(samples, key, ts, value, rows_per_chunk)
    span = int(range_s * _MICROS)
    point = F.struct(F.col("_t").alias("t"), F.col("_c").alias("c"))
    if not rows.split and _densest(samples, key, ts, span) <= FRAME_ROWS:
        by_time = Window.partitionBy(*rows.chunk_key).orderBy("_t")
        in_range = by_time.rangeBetween(-span, Window.currentRow)
        # the counter only grows, so the smallest point is the first, also among equal times
        df = rows.df.withColumn("_first", F.min(point).over(in_range))
    else:
        df = _first_in_range(rows.df, samples, key, ts, span, rows_per_chunk)
    return df.withColumn(out, _slope(F.col("_first"), point)).drop(
        "_t", "_c", "_step", "_before", "_first", CHUNK, HOT, "_start"
    )


def _densest(samples: DataFrame, key: Sequence[str], ts: str, span: int) -> int:
    """Most samples of one key in one aligned stretch of the range's length (map-side combined
    counts; one number comes back)."""
    stretch = F.floor(_micros(ts) / span).alias("_stretch")
    counts = samples.groupBy(*key, stretch).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _places(df: DataFrame, key: Sequence[str], ts: str, role: int, shift: int = 0) -> DataFrame:
    """Key and place in the merged order only, read straight from an input: the cuts of a merged
    frame are planned from these instead of running the windows below it once more."""
    return df.select(*key, (_micros(ts) + shift).alias("_at"), F.lit(role).alias("_role"))


def _first_in_range(
    df: DataFrame,
    samples: DataFrame,
    key: Sequence[str],
    ts: str,
    span: int,
    rows_per_chunk: int | None,
) -> DataFrame:
    """First sample within ``span`` before each row, without a range frame.

    A sample leaves the range ``span`` after its own time. With these leave events merged into
    the row order, the first sample still in range is the one of the next leave event.
    """
    df = df.drop(CHUNK, HOT, "_start")
    point = F.struct(F.col("_t").alias("t"), F.col("_c").alias("c"))
    # both rows come from one pass; a leave event carries nothing but the key and its sample
    rest = [c for c in df.columns if c not in key]
    both = df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_role")).select(
        *key,
        *[F.when(F.col("_role") == 0, F.col(c)).alias(c) for c in rest],
        (F.col("_t") + F.col("_role") * F.lit(span)).alias("_at"),
        "_role",
        F.when(F.col("_role") == 1, point).alias("_leaving"),
        F.col("_c").alias("_tie"),
    )
    merged = ordered(
        both,
        key,
        ["_at", "_role"],
        rows_per_chunk,
        ties=["_tie"],
        plan_from=_places(samples, key, ts, 0).union(_places(samples, key, ts, 1, span)),
    )
    return (
        merged.running(_first=following(F.col("_leaving")))
        .df.where(F.col("_role") == 0)
        .drop("_at", "_role", "_leaving", "_tie", CHUNK, HOT)
    )


def instant_rate(
    samples: DataFrame,
    range_s: float,
    key: Sequence[str] = ("instance",),
    ts: str = "ts",
    value: str = "value",
    out: str = "rate",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Rate from the last two samples; null when they are further apart than the range. Samples of
    one time count in the order of their values and have no rate between them."""
    rows = ordered(
        samples.withColumn("_t", _micros(ts)), key, ["_t"], rows_per_chunk, ties=[value]
    )
    rows = rows.running(
        _p=previous(F.struct(F.col("_t").alias("t"), F.col(value).alias("v")))
    )
    grown = F.when(F.col(value) < F.col("_p.v"), F.col(value)).otherwise(
        F.col(value) - F.col("_p.v")
    )
    gap = F.col("_t") - F.col("_p.t")
    near = (gap <= int(range_s * _MICROS)) & (gap > 0)
    return (
        rows.with_columns(**{out: F.when(near, grown / (gap / _MICROS))}).result().drop("_t", "_p")
    )


def eval_grid(bounds: DataFrame, step_s: int, start: str = "start", end: str = "end") -> DataFrame:
    """One row per evaluation tick from start to end (inclusive) of each row of ``bounds``."""
    rest = [c for c in bounds.columns if c not in (start, end)]
    step = F.lit(int(step_s) * _MICROS)
    return explode_steps(bounds, start, end, step, "tick").select(*rest, "tick")


def asof_latest(
    samples: DataFrame,
    ticks: DataFrame,
    lookback_s: float,
    key: Sequence[str] = ("instance",),
    ts: str = "ts",
    value: str = "value",
    tick: str = "tick",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Latest sample at or before each tick, unless older than the lookback.

    Samples and ticks are merged in time order and the last sample is carried forward: linear,
    and no pair of a tick and a sample is ever formed. Adds ``value`` and ``sample_ts``. Of samples
    of one time the largest counts.
    """
    seen = samples.select(
        *key,
        _micros(ts).alias("_at"),
        F.lit(0).alias("_role"),
        F.struct(F.col(ts).alias("ts"), F.col(value).alias("v"), _micros(ts).alias("t")).alias(
            "_s"
        ),
        F.col(value).alias("_tie"),
    )
    asked = ticks.withColumns({"_at": _micros(tick), "_role": F.lit(1)})
    rows = ordered(
        seen.unionByName(asked, allowMissingColumns=True),
        key,
        ["_at", "_role"],
        rows_per_chunk,
        ties=["_tie"],
    ).running(_last=latest(F.col("_s")))
    fresh = F.col("_at") - F.col("_last.t") <= int(lookback_s * _MICROS)
    return (
        rows.df.where(F.col("_role") == 1)
        .withColumns(
            {
                "value": F.when(fresh, F.col("_last.v")),
                "sample_ts": F.when(fresh, F.col("_last.ts")),
            }
        )
        .select(*ticks.columns, "sample_ts", "value")
    )


def rate_at_ticks(
    samples: DataFrame,
    ticks: DataFrame,
    range_s: float,
    key: Sequence[str] = ("instance",),
    ts: str = "ts",
    value: str = "value",
    tick: str = "tick",
    out: str = "rate",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Counter rate over the trailing range at each grid tick."""
    span = int(range_s * _MICROS)
    growth = _with_growth(samples.select(*key, ts, value), key, ts, value, rows_per_chunk).df
    point = F.struct(F.col("_t").alias("t"), F.col("_c").alias("c"))
    # role 0 arrives, 1 asks, 2 leaves the range
    moves = growth.select(
        *key, "_t", point.alias("_p"), F.explode(F.array(F.lit(0), F.lit(2))).alias("_role")
    ).select(
        *key,
        F.when(F.col("_role") == 2, F.col("_t") + span).otherwise(F.col("_t")).alias("_at"),
        "_role",
        F.when(F.col("_role") == 0, F.col("_p")).alias("_arriving"),
        F.when(F.col("_role") == 2, F.col("_p")).alias("_leaving"),
        F.col("_p.c").alias("_tie"),
    )
    asked = ticks.withColumns({"_at": _micros(tick), "_role": F.lit(1)})
    merged = moves.unionByName(asked, allowMissingColumns=True)
    places = (
        _places(samples, key, ts, 0)
        .union(_places(ticks, key, tick, 1))
        .union(_places(samples, key, ts, 2, span))
    )
    rows = ordered(
        merged, key, ["_at", "_role"], rows_per_chunk, plan_from=places, ties=["_tie"]
    ).running(_last=latest(F.col("_arriving")), _first=following(F.col("_leaving")))
    return (
        rows.df.where(F.col("_role") == 1)
        .withColumn(out, _slope(F.col("_first"), F.col("_last")))
        .select(*ticks.columns, out)
    )


# ------------------------------------------------------------------------ rows and sequences


def make_sequences(
    df: DataFrame,
    feats: Sequence[str],
    length: int = 10,
    drop_last: bool = True,
    by: Sequence[str] = ("instance",),
    order: Sequence[str] = ("ts",),
    keep: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Sliding sequences (stride 1) of ``length`` rows as an array of feature arrays.

    ``drop_last`` leaves out the last possible sequence of each key, so n rows give n - length.
    ``by=()`` slides over the whole table as one series.
    """
    keys = list(by)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    cols = list(dict.fromkeys([*keys, *order, *keep, *feats]))
    rows = ordered(df.select(*cols), keys, order, rows_per_chunk)
    body = rows.df.withColumn("_halo", F.lit(False))
    if rows.split:
        body = body.unionByName(_next_rows(rows, length))
    w = Window.partitionBy(*rows.chunk_key).orderBy(*order)
    step = F.array(*[F.col(c).cast("double") for c in feats])
    reach = length if drop_last else length - 1
    return (
        body.withColumns(
            {
                "seq": F.collect_list(step).over(w.rowsBetween(0, length - 1)),
                "_full": F.lead(F.lit(True), reach).over(w) if reach else F.lit(True),
            }
        )
        .where(F.col("_full") & ~F.col("_halo"))
        .select(*[c for c in dict.fromkeys([*by, *order, *keep])], "seq")
    )


def _next_rows(rows: OrderedRows, n: int) -> DataFrame:
    """Copies of the n rows that follow each chunk of a split key, tagged ``_halo``.

    Every chunk but the first holds at least one row, so they lie within the next n chunks.
    """
    in_chunk = rows.window
    heads = (
        rows.df.where(F.col(HOT) & (F.col(CHUNK) > 0))
        .withColumn("_rn", F.row_number().over(in_chunk))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
    back = F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col(CHUNK)))).alias("_back")
    copies = heads.select("*", back).withColumn(CHUNK, F.col(CHUNK) - F.col("_back"))
    return (
        copies.drop("_back")
        .withColumn("_rn", F.row_number().over(in_chunk))
        .where(F.col("_rn") <= n)
        .drop("_rn")
        .withColumn("_halo", F.lit(True))
    )


def last_n_rows(
    df: DataFrame, key: Sequence[str], n: int, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Newest n rows per key with ``rn`` 1 = newest. Spark keeps n per key and task before the
    shuffle (WindowGroupLimit), so a busy key sends n rows per task, not its history."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def last_n(
    df: DataFrame,
    key: Sequence[str],
    n: int,
    cols: Sequence[str],
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Newest n rows per key as one array of structs, oldest first."""
    item = F.struct((-F.col("rn")).alias("_k"), *cols)
    return (
        last_n_rows(df, key, n, order)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(item)).alias("_rows"))
        .select(
            *key,
            F.transform(
                "_rows", lambda r: F.struct(*[r[c].alias(c) for c in cols])
            ).alias("rows"),
        )
    )


def align_last_n(
    series: DataFrame,
    n: int = 10,
    key: Sequence[str] = ("node",),
    metrics: Sequence[str] = ("cpu", "mem", "net_in", "net_out"),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """k-th newest sample of every metric side by side (whatever their times), last n, oldest
    first; a key with fewer than n points of any metric gives nothing."""
    newest = last_n_rows(series.where(F.col("metric").isin(*metrics)), [*key, "metric"], n, order)
    steps = newest.groupBy(*key, "rn").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics],
        F.count(F.lit(1)).alias("_n"),
    )
    item = F.struct((-F.col("rn")).alias("_k"), F.array(*metrics).alias("f"))
    return (
        steps.where(F.col("_n") == len(metrics))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(item)).alias("_s"))
        .where(F.size("_s") == n)
        .select(*key, F.transform("_s", lambda s: s["f"]).alias("seq"))
    )


def series_for_plot(
    df: DataFrame,
    cols: Sequence[str] = ("cpu", "score"),
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    cpu_line: float = 5.0,
    score_line: float = 0.08,
    global_index: bool = False,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Chart data: 0-based ``time_step`` per key (or over the whole table) and line levels."""
    by = ["_all"] if global_index else list(key)
    rows = ordered(df.withColumn("_all", F.lit(0)), by, order, rows_per_chunk)
    return (
        rows.running(_pos=position())
        .df.withColumns(
            {
                "time_step": F.col("_pos") - 1,
                "cpu_line": F.lit(cpu_line),
                "score_line": F.lit(score_line),
            }
        )
        .select(*key, "time_step", *cols, "cpu_line", "score_line")
    )


def with_params(df: DataFrame, params: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Attach fitted parameters to every row.

    Without ``on`` the frame must have one row, which goes to all rows. With ``on`` it must have one
    row per key (node, policy); rows whose key has none are left out. More rows fail the job.
    """
    rest = [c for c in params.columns if c not in on]
    rows = params.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_p")
    )
    where = f" for one of {', '.join(on)}" if on else ""
    only = F.when(F.col("_n") == 1, F.col("_p")).otherwise(
        F.raise_error(F.lit(f"more than one row of parameters{where}"))
    )
    rows = rows.where("_n > 0").select(*on, only.alias("_p")).select(*on, "_p.*")
    if on:
        return df.join(rows, list(on))
    return df.crossJoin(F.broadcast(rows))  # an aggregate without keys: one row
