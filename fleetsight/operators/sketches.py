"""Mergeable sketches for recalibration: counts, moments, quantiles and distinct items of any span of
windows, without another scan of the events.

A sketch is a handful of rows per (keys, window), so it is stored, appended and partitioned like any table:

* ``moments``: count, sum, sum of squared deviations, least and greatest value;
* ``bucket``: counts per logarithmic bucket of the value. A quantile of the merged counts is within the
  share ``alpha`` of the value at that rank (lower one of two);
* ``hash``: the ``k`` smallest different hashes of the item. Fewer than ``k``: the distinct count is exact;
  else its standard error is about 1 / sqrt(k - 2).

Sketches merge to the rows that one pass over the whole span would give (sums of squares up to rounding), in
any order, and depend on no random numbers. All steps combine map side; a window's size does not matter.

Defined cases: null, NaN and infinite values have no part in ``moments`` and ``bucket``; null items none in
``hash``; rows without a time none at all; a null key is a key; an empty table gives empty frames; a group
without values has null estimates, one without items zero distinct ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.005
SMALLEST = 1024
HASH_BITS = 60
_ZERO_AT = 1_000_000  # slot of bucket 0 of positive values; buckets of doubles lie within it on both sides
_NUMBERS = ("n", "total", "deviations", "low", "high")


def _log_gamma(alpha: float) -> float:
    if not 0.001 <= alpha < 1:  # finer ones would leave the slots
        raise ValueError("alpha must be at least 0.001 and below 1")
    return math.log((1 + alpha) / (1 - alpha))


def bucket_slot(x: Column, alpha: float = ALPHA) -> Column:
    """Ordered bucket number of a finite value: zero, or the power of gamma at or above its size."""
    place = F.ceil(F.log(F.abs(x)) / F.lit(_log_gamma(alpha))).cast("long") + _ZERO_AT
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, place).otherwise(-place)


def bucket_value(slot: Column, alpha: float = ALPHA) -> Column:
    """The value that is within ``alpha`` of all values of a bucket."""
    size = F.exp((F.abs(slot) - _ZERO_AT) * F.lit(_log_gamma(alpha))) * F.lit(1 - alpha)
    return F.when(slot == 0, 0.0).when(slot > 0, size).otherwise(-size)


def item_hash(item: Column) -> Column:
    """A number below 2^60 that other engines can compute as well."""
    return F.conv(F.substring(F.md5(item.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _rows(df: DataFrame, keys: Sequence[str], kind: str, slot: Column, **numbers: Column) -> DataFrame:
    types = {"n": "long"}
    cells = [numbers.get(c, F.lit(None)).cast(types.get(c, "double")).alias(c) for c in _NUMBERS]
    return df.select(*keys, "window_start", F.lit(kind).alias("kind"), slot.cast("long").alias("slot"), *cells)


def _smallest(hashes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` smallest different slots per group; ranked in each task before the groups meet."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))
    return hashes.distinct().withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sketch_windows(
    df: DataFrame,
    value: str,
    item: str,
    keys: Sequence[str] = (),
    window: str = "1 hour",
    ts: str = "ts",
    alpha: float = ALPHA,
    k: int = SMALLEST,
) -> DataFrame:
    """Sketch rows (keys, window_start, kind, slot, n, total, deviations, low, high) of each window."""
    if k < 3:
        raise ValueError("k must be at least 3")
    keys = list(keys)
    x = F.col(value).cast("double")
    group = [*keys, "window_start"]
    seen = df.select(*keys, F.window(ts, window)["start"].alias("window_start"), x.alias("_x"), F.col(item).alias("_item"))
    infinite = F.col("_x").isin(float("inf"), float("-inf"))
    finite = seen.where(F.col("_x").isNotNull() & ~F.isnan("_x") & ~infinite)
    moments = finite.groupBy(*group).agg(
        F.count("_x").alias("n"),
        F.sum("_x").alias("total"),
        (F.var_pop("_x") * F.count("_x")).alias("deviations"),
        F.min("_x").alias("low"),
        F.max("_x").alias("high"),
    )
    buckets = finite.select(*group, bucket_slot(F.col("_x"), alpha).alias("slot")).groupBy(*group, "slot").agg(F.count("slot").alias("n"))
    hashes = seen.where(F.col("_item").isNotNull()).select(*group, item_hash(F.col("_item")).alias("slot"))
    parts = [
        _rows(moments, keys, "moments", F.lit(0), **{c: F.col(c) for c in _NUMBERS}),
        _rows(buckets, keys, "bucket", F.col("slot"), n=F.col("n")),
        _rows(_smallest(hashes, group, k), keys, "hash", F.col("slot")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by keys that may be null (or by none, to one row)."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], F.lit(True))
    return left.join(right, on, how).drop(*[f"_r_{c}" for c in keys])


def _merged(sketches: DataFrame, keys: Sequence[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moments, buckets, hashes) per key."""
    of = {kind: sketches.where(F.col("kind") == kind) for kind in ("moments", "bucket", "hash")}
    sums = of["moments"].groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    whole = sums.select(*keys, (F.col("total") / F.col("n")).alias("_mean"))
    gap = F.col("total") / F.col("n") - F.col("_mean")
    # around the mean of the whole: sums of squares themselves would cancel
    spread = _same(of["moments"], whole, keys).groupBy(*keys).agg(F.sum(F.col("deviations") + F.col("n") * gap * gap).alias("deviations"))
    buckets = of["bucket"].groupBy(*keys, "slot").agg(F.sum("n").alias("n"))
    return _same(sums, spread, keys), buckets, _smallest(of["hash"].select(*keys, "slot"), keys, k)


def roll_up(sketches: DataFrame, window: str, keys: Sequence[str] = (), k: int = SMALLEST) -> DataFrame:
    """Sketches of coarser windows, as if made from the rows themselves."""
    keys = list(keys)
    coarse = sketches.withColumn("window_start", F.window("window_start", window)["start"])
    moments, buckets, hashes = _merged(coarse, [*keys, "window_start"], k)
    parts = [
        _rows(moments, keys, "moments", F.lit(0), **{c: F.col(c) for c in _NUMBERS}),
        _rows(buckets, keys, "bucket", F.col("slot"), n=F.col("n")),
        _rows(hashes, keys, "hash", F.col("slot")),
    ]
    return reduce(DataFrame.unionByName, parts)


def span_of(sketches: DataFrame, start: Column, end: Column) -> DataFrame:
    """The windows that begin in [start, end); a filter that reaches the scan of stored sketches."""
    return sketches.where((F.col("window_start") >= start) & (F.col("window_start") < end))


def recalibrated(
    sketches: DataFrame,
    quantiles: dict[str, float],
    keys: Sequence[str] = (),
    sigmas: float = 3.0,
    alpha: float = ALPHA,
    k: int = SMALLEST,
) -> DataFrame:
    """(keys, n, mean, std, threshold, the named quantiles, distinct) over all windows given. ``alpha`` and
    ``k`` are those the sketches were made with."""
    keys = list(keys)
    moments, buckets, hashes = _merged(sketches, keys, k)
    mean, std = F.col("total") / F.col("n"), F.sqrt(F.col("deviations") / F.col("n"))
    known = moments.select(
        *keys, "n", "low", "high", mean.alias("mean"), std.alias("std"), (mean + sigmas * std).alias("threshold")
    )
    # A group has a bounded number of buckets, whatever its rows.
    placed = Window.partitionBy(*keys).orderBy("slot")
    upto = buckets.withColumns({"_upto": F.sum("n").over(placed), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    at = [
        F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("slot"))).alias(name)
        for name, p in quantiles.items()
    ]
    found = upto.groupBy(*keys).agg(F.count(F.lit(1)).alias("_buckets"), *at).drop("_buckets")
    counted = hashes.groupBy(*keys).agg(F.count("slot").alias("_m"), F.max("slot").alias("_kth"))
    guess = F.round(F.lit(float(k - 1)) * F.lit(float(1 << HASH_BITS)) / F.col("_kth")).cast("long")
    counted = counted.select(*keys, F.when(F.col("_m") < k, F.col("_m")).otherwise(guess).alias("distinct"))
    groups = sketches.select(*keys).distinct() if keys else sketches.agg(F.count(F.lit(1)).alias("_some")).drop("_some")
    out = reduce(lambda left, right: _same(left, right, keys, "left"), [known, found, counted], groups)
    values = [F.greatest("low", F.least("high", bucket_value(F.col(q), alpha))).alias(q) for q in quantiles]
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, F.coalesce("n", zero).alias("n"), "mean", "std", "threshold", *values, F.coalesce("distinct", zero).alias("distinct")
    )
