"""Order-dependent operators over keys of any size.

A running value per key (previous row, running total, last seen value, bounded score) is a
window function, and a plain ``Window.partitionBy(key)`` sends the whole history of a key to
one task. One busy node may own a third of all rows, so the window is cut:

1. keys with more than ``rows_per_chunk`` rows get *split points*, taken from a sample that is
   a pure function of row content (a hash), so that every evaluation sees the same cuts;
2. each row gets ``_chunk`` = number of split points at or before it (binary search in the
   broadcast split array, JVM side); small keys stay in chunk 0;
3. window functions run per ``(key, _chunk)``: one shuffle, balanced;
4. one summary row per chunk of a split key is combined over the chunks of that key, and the
   resulting *carry* is joined back. The carry has at most rows / rows_per_chunk rows.

When no key is over the limit, steps 1, 2 and 4 vanish and what is left is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.plans.sizing import BROADCAST_ROW_LIMIT, broadcast_if_small

CHUNK = "_chunk"
HOT = "_hot"
ROWS_PER_CHUNK_CONF = "spark.fleetsight.rowsPerChunk"
DEFAULT_ROWS_PER_CHUNK = 2_000_000

_SAMPLES_PER_CHUNK = 16
_HASH_RANGE = 1 << 30


def _and(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match; key columns are kept from the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = _and([left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


# --------------------------------------------------------------------------- running values


@dataclass(frozen=True)
class Running:
    """One running value: its window form, its per-chunk summary and how carries combine."""

    local: Callable[[WindowSpec, Sequence[str]], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    combine: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda c: c


def _up_to_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def previous(value: Column) -> Running:
    """Value of the row just before this one (null on the first row of a key)."""
    boxed = F.struct(value.alias("v"))
    return Running(
        local=lambda w, order: F.lag(boxed).over(w),
        summary=lambda order: F.max_by(boxed, order),
        carry=lambda s, w: F.lag(s).over(w),
        combine=F.coalesce,
        finish=lambda c: c["v"],
    )


def latest(value: Column) -> Running:
    """Last non-null value at or before this row."""
    return Running(
        local=lambda w, order: F.last(value, ignorenulls=True).over(_up_to_here(w)),
        summary=lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        combine=F.coalesce,
    )


def following(value: Column) -> Running:
    """First non-null value at or after this row."""

    def local(w: WindowSpec, order: Sequence[str]) -> Column:
        # A running frame over the reversed order: linear, unlike UNBOUNDED FOLLOWING.
        reverse = w.orderBy(*[F.desc(c) for c in order])
        return F.last(value, ignorenulls=True).over(_up_to_here(reverse))

    return Running(
        local=local,
        summary=lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(
            _before(w.orderBy(F.desc(CHUNK)))
        ),
        combine=F.coalesce,
    )


def total(value: Column) -> Running:
    """Running sum including this row. Pass an integer column where exactness matters."""
    return Running(
        local=lambda w, order: F.sum(value).over(_up_to_here(w)),
        summary=lambda order: F.sum(value),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        combine=lambda here, carry: F.coalesce(here + carry, here, carry),
    )


def position() -> Running:
    """1-based row number within the key."""
    return total(F.lit(1).cast("long"))


# ------------------------------------------------------------------------------- clamp scans


@dataclass(frozen=True)
class Clamp:
    """A running value x -> min(hi, max(lo, x + delta)) with per-row delta, lo and hi.

    A bounded score, a latch (lo = hi = 1), a hysteresis flag (set, clear or hold) and a reset
    (lo = hi = 0) are all maps of this family, which is closed under composition.
    """

    name: str
    delta: Column
    lo: Column
    hi: Column
    init: float | Column  # value before the first row; a column must be constant per key

    def init_column(self) -> Column:
        return (self.init if isinstance(self.init, Column) else F.lit(self.init)).cast("double")


NEG_INF = float("-inf")
POS_INF = float("inf")


def hold_unless(set_when: Column, clear_when: Column | None = None) -> tuple[Column, Column]:
    """(lo, hi) of a flag that becomes 1, becomes 0 or keeps its value."""
    lo = F.when(set_when, F.lit(1.0))
    hi = F.when(set_when, F.lit(1.0))
    if clear_when is not None:
        lo = lo.when(clear_when, F.lit(0.0))
        hi = hi.when(clear_when, F.lit(0.0))
    return lo.otherwise(F.lit(NEG_INF)), hi.otherwise(F.lit(POS_INF))


def compose_prefixes(
    delta: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All prefix compositions of clamp maps, by doubling (log2 n vectorized passes)."""
    shift, n = 1, len(delta)
    while shift < n and not np.array_equal(lo, hi):
        d, low, high = delta[shift:], lo[shift:], hi[shift:]
        new_lo = np.minimum(high, np.maximum(low, lo[:-shift] + d))
        new_hi = np.minimum(high, np.maximum(low, hi[:-shift] + d))
        new_delta = delta[:-shift] + d
        lo = np.concatenate([lo[:shift], new_lo])
        hi = np.concatenate([hi[:shift], new_hi])
        delta = np.concatenate([delta[:shift], new_delta])
        shift *= 2
    return delta, lo, hi


def _scan_batches(
    names: Sequence[str], keep: Sequence[str], schema: pa.Schema | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow task body: expand clamp scans along rows that arrive sorted within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            start = column["_start"].to_numpy(zero_copy_only=False)
            arrays = [column[c] for c in keep]
            for name in names:
                d, low, high, init = (
                    column[f"_{part}_{name}"].to_numpy(zero_copy_only=False)
                    for part in ("delta", "lo", "hi", "init")
                )
                # A row whose input is known is a constant map, which absorbs all before it;
                # so chunk starts need no segment bookkeeping.
                before = np.where(start, init, np.nan)
                if not start[0]:
                    before[0] = tail[name]
                known = ~np.isnan(before)
                value = np.minimum(high, np.maximum(low, np.where(known, before, 0.0) + d))
                lo = np.where(known, value, low)
                hi = np.where(known, value, high)
                _, after, _ = compose_prefixes(np.where(known, 0.0, d), lo, hi)
                shifted = np.concatenate([[0.0], after[:-1]])
                tail[name] = float(after[-1])
                arrays.append(pa.array(np.where(known, before, shifted)))
                arrays.append(pa.array(after))
            fields = list(keep) + [f"{p}{n}" for n in names for p in ("prev_", "")]
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return run


# ------------------------------------------------------------------------------- the layout


@dataclass(frozen=True)
class OrderedRows:
    """Rows of ``df`` in a total order per key, cut into bounded chunks."""

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    n_chunks: int = 0  # chunks of split keys; 0 = no key was split
    sorted_in_tasks: bool = False  # rows of a chunk are contiguous and sorted, `_start` is set

    @property
    def split(self) -> bool:
        return self.n_chunks > 0

    @property
    def chunk_key(self) -> tuple[str, ...]:
        return (*self.key, CHUNK)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.chunk_key).orderBy(*self.order)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK, HOT, "_start")

    def with_columns(self, **columns: Column) -> OrderedRows:
        return replace(self, df=self.df.withColumns(columns))

    def _order_struct(self) -> Column:
        return F.struct(*self.order)

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        return _join_null_safe(
            df, broadcast_if_small(carry, self.n_chunks), self.chunk_key, "left"
        )

    def running(self, **specs: Running) -> OrderedRows:
        """Add running values; all of them share one shuffle and one carry join."""
        local = {
            f"_l_{n}" if self.split else n: (
                s.local(self.window, self.order)
                if self.split
                else s.finish(s.local(self.window, self.order))
            )
            for n, s in specs.items()
        }
        df = self.df.withColumns(local)
        if not self.split:
            return replace(self, df=df, sorted_in_tasks=False)
        summary = (
            self.df.where(HOT)
            .groupBy(*self.chunk_key)
            .agg(*[s.summary(self._order_struct()).alias(f"_s_{n}") for n, s in specs.items()])
        )
        over_chunks = Window.partitionBy(*self.key).orderBy(CHUNK)
        carry = summary.select(
            *self.chunk_key,
            *[s.carry(F.col(f"_s_{n}"), over_chunks).alias(f"_c_{n}") for n, s in specs.items()],
        )
        df = self._join_carry(df, carry)
        df = df.withColumns(
            {n: s.finish(s.combine(F.col(f"_l_{n}"), F.col(f"_c_{n}"))) for n, s in specs.items()}
        ).drop(*[f"_{p}_{n}" for n in specs for p in ("l", "c")])
        return replace(self, df=df, sorted_in_tasks=False)

    def scan(self, *clamps: Clamp) -> OrderedRows:
        """Add ``name`` (value after the row) and ``prev_name`` (value before it) per clamp."""
        starts: dict[str, Column] = {c.name: c.init_column() for c in clamps}
        rows = self
        if self.split:
            carry = self._scan_carry(clamps)
            # Nothing promises that a join keeps row order, so the expansion sorts again.
            rows = replace(self, df=self._join_carry(self.df, carry), sorted_in_tasks=False)
            starts = {
                c.name: F.coalesce(F.col(f"_carry_{c.name}"), c.init_column())
                for c in clamps
            }
        keep = self.df.columns
        return rows._expand(clamps, starts, keep)

    def _scan_carry(self, clamps: Sequence[Clamp]) -> DataFrame:
        """Value each chunk of a split key starts from.

        A chunk's map is fixed by its images of -inf and +inf plus its delta sum, so the chunk
        is expanded from both ends of the line; the few chunk maps are then scanned in turn.
        """
        hot = replace(self, df=self.df.where(HOT))
        probes = [
            replace(c, name=f"{side}_{c.name}", init=init)
            for c in clamps
            for side, init in (("lo", NEG_INF), ("hi", POS_INF))
        ]
        needed = [*self.chunk_key, *self.order]
        extra = {f"_d_{c.name}": c.delta.cast("double") for c in clamps}
        extra.update({f"_i_{c.name}": c.init_column() for c in clamps})
        probed = hot.with_columns(**extra)._expand(
            probes, {p.name: p.init_column() for p in probes}, [*dict.fromkeys(needed), *extra]
        )
        order = F.struct(*self.order)
        chunks = probed.df.groupBy(*self.chunk_key).agg(
            *[F.sum(f"_d_{c.name}").alias(f"_d_{c.name}") for c in clamps],
            *[F.max(f"_i_{c.name}").alias(f"_i_{c.name}") for c in clamps],
            *[F.max_by(p.name, order).alias(p.name) for p in probes],
        )
        over_chunks = OrderedRows(
            chunks.withColumnRenamed(CHUNK, "_chunk_no").withColumn(CHUNK, F.lit(0)),
            self.key,
            ("_chunk_no",),
        )
        folded = over_chunks._expand(
            [
                Clamp(
                    c.name,
                    F.col(f"_d_{c.name}"),
                    F.col(f"lo_{c.name}"),
                    F.col(f"hi_{c.name}"),
                    F.col(f"_i_{c.name}"),
                )
                for c in clamps
            ],
            {c.name: F.col(f"_i_{c.name}") for c in clamps},
            [*self.key, "_chunk_no"],
        ).df
        return folded.select(
            *self.key,
            F.col("_chunk_no").alias(CHUNK),
            *[F.col(f"prev_{c.name}").alias(f"_carry_{c.name}") for c in clamps],
        )

    def _expand(
        self, clamps: Sequence[Clamp], starts: dict[str, Column], keep: Sequence[str]
    ) -> OrderedRows:
        df = self.df
        keep = list(keep)
        if not self.sorted_in_tasks:
            # The window sorts each task by (key, chunk, order); Arrow batches keep that order.
            df = df.withColumn("_start", F.row_number().over(self.window) == 1)
        if "_start" not in keep:
            keep.append("_start")
        inputs = {}
        for c in clamps:
            inputs[f"_delta_{c.name}"] = c.delta.cast("double")
            inputs[f"_lo_{c.name}"] = c.lo.cast("double")
            inputs[f"_hi_{c.name}"] = c.hi.cast("double")
            inputs[f"_init_{c.name}"] = starts[c.name].cast("double")
        df = df.select(*keep, *[v.alias(n) for n, v in inputs.items()])
        names = [c.name for c in clamps]
        out = T.StructType([f for f in df.schema.fields if f.name in keep])
        for n in names:
            out = out.add(f"prev_{n}", T.DoubleType()).add(n, T.DoubleType())
        return replace(
            self, df=df.mapInArrow(_scan_batches(names, keep), out), sorted_in_tasks=True
        )


def rows_per_chunk_of(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(ROWS_PER_CHUNK_CONF, None)
    return int(conf) if conf else DEFAULT_ROWS_PER_CHUNK


def ordered(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    rows_per_chunk: int | None = None,
    plan_from: DataFrame | None = None,
    ties: Sequence[str] = (),
) -> OrderedRows:
    """Lay ``df`` out for running values per ``key`` in ``order``, rows equal in it by ``ties``
    (together a total order). Keys are cut by ``order`` alone, so equal rows stay together.

    Counts rows per key once (column-pruned, combined map side) and brings back only the keys
    over the limit: at most rows / rows_per_chunk of them. ``plan_from`` is a cheaper frame to
    plan the cuts from: it must hold the key and order of every row of ``df``, and may hold more
    (any cuts give right results; those of a superset are balanced enough).
    """
    limit = rows_per_chunk or rows_per_chunk_of(df)
    key, order = tuple(key), tuple(order)
    source = plan_from if plan_from is not None else df
    hot = (
        source.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .toArrow()
    )
    full = (*order, *ties)
    if hot.num_rows == 0:
        return OrderedRows(df.withColumn(CHUNK, F.lit(0)), key, full)

    spark = df.sparkSession
    hot_keys = broadcast_if_small(spark.createDataFrame(hot).drop("_n"), hot.num_rows)
    cols = list(dict.fromkeys([*key, *order]))
    sample = _join_null_safe(source.select(*cols), hot_keys, key, "inner").where(
        F.pmod(F.xxhash64(*cols), F.lit(_HASH_RANGE))
        < max(1, _HASH_RANGE * _SAMPLES_PER_CHUNK // limit)
    )
    ranked = sample.distinct().withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    )
    splits = (
        ranked.where(F.col("_rn") % _SAMPLES_PER_CHUNK == 0)
        .select(*key, F.struct(*order).alias("_split"))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("_split")).alias("_splits"))
        .toArrow()
    )
    lengths = pc.list_value_length(splits.column("_splits"))
    n_splits = pc.sum(lengths).as_py() or 0
    if n_splits == 0:
        return OrderedRows(df.withColumn(CHUNK, F.lit(0)), key, full)
    split_rows = broadcast_if_small(
        spark.createDataFrame(splits), n_splits, BROADCAST_ROW_LIMIT
    )
    joined = _join_null_safe(df, split_rows, key, "left")
    here = F.struct(*order)
    points = F.col("_splits")
    steps = [1 << b for b in reversed(range(pc.max(lengths).as_py().bit_length()))]
    chunk = F.aggregate(  # binary search: number of split points at or before the row
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda p, s: F.when(
            (p + s <= F.size(points)) & (F.get(points, p + s - 1) <= here), p + s
        ).otherwise(p),
    )
    chunked = joined.withColumns(
        {
            HOT: points.isNotNull(),
            CHUNK: F.when(points.isNotNull(), chunk).otherwise(F.lit(0)),
        }
    ).drop("_splits")
    return OrderedRows(chunked, key, full, n_chunks=n_splits + splits.num_rows)
