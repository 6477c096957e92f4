"""First-match labeling by padded scenario windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.scalars import epoch_seconds, parse_iso
from fleetsight.plans.sizing import count_up_to

START_PAD = 10
END_PAD = 15
DEFAULT_LABEL = "normal"
ARRAY_LIMIT = 64  # windows that are tried one by one per row; more go through the time tree
CELL_LIMIT = 100_000  # tree cells that are broadcast; more are joined by a shuffle


def label_by_windows(
    df: DataFrame,
    windows: DataFrame,
    start_pad: int = START_PAD,
    end_pad: int = END_PAD,
    epoch: str | Column = "epoch",
    default: str = DEFAULT_LABEL,
    array_limit: int = ARRAY_LIMIT,
) -> DataFrame:
    """Set ``label`` to that of the first window (lowest ``pos``, of any type with an order) with
    start + start_pad <= epoch <= end + end_pad, else to ``default``.

    Few windows: one broadcast array, first hit taken per row; no shuffle. Many windows: the time
    tree below. Neither forms (row, window) pairs.
    """
    padded = windows.select(
        (F.col("start_time") + start_pad).alias("s"),
        (F.col("end_time") + end_pad).alias("e"),
        "label",
        "pos",
    ).where(F.col("s") <= F.col("e"))
    moment = F.col(epoch) if isinstance(epoch, str) else epoch
    rows = df.drop("label") if "label" in df.columns else df
    rows = rows.withColumn("_epoch", moment.cast("bigint"))
    if count_up_to(padded, array_limit) <= array_limit:
        labeled = _by_array(rows, padded, default)
    else:
        labeled = _by_tree(rows, padded, default)
    labeled = labeled.drop("_epoch")
    if "label" in df.columns:
        return labeled.select(*df.columns)
    first, *rest = df.columns
    return labeled.select(first, "label", *rest)


def _by_array(rows: DataFrame, padded: DataFrame, default: str) -> DataFrame:
    """``padded`` has at most ``array_limit`` rows here."""
    packed = padded.agg(
        F.sort_array(F.collect_list(F.struct("pos", "s", "e", "label"))).alias("_ws")
    )
    hit = F.get(
        F.filter(
            "_ws", lambda w: (w["s"] <= F.col("_epoch")) & (F.col("_epoch") <= w["e"])
        ),
        F.lit(0),
    )
    return (
        rows.crossJoin(F.broadcast(packed))
        .withColumn("label", F.coalesce(hit["label"], F.lit(default)))
        .drop("_ws")
    )


def window_cells(padded: DataFrame) -> DataFrame:
    """Cut windows into aligned power-of-two time cells and keep the first window per cell.

    A window of n seconds needs at most two cells per level, so 2*log2(n) in all; windows that
    share a cell are reduced to one by a map-side combined minimum. A moment lies in exactly one
    cell per level, hence its first window is the minimum over the levels in use.
    """
    top = (F.floor(F.log2(F.col("e") + 2 - F.col("s"))) + 1).cast("int")  # no larger cell fits
    spans = padded.select(
        "pos",
        "label",
        "s",
        (F.col("e") + 1).alias("t"),  # half open [s, t)
        F.explode(F.sequence(F.lit(0), top)).alias("level"),
    )
    width = F.expr("shiftleft(1L, level)")
    # first and past-the-end whole cell of this level inside the window
    ends = spans.select(
        "pos",
        "label",
        "level",
        F.ceil(F.col("s") / width).cast("bigint").alias("a"),
        F.floor(F.col("t") / width).cast("bigint").alias("b"),
    ).where(F.col("a") < F.col("b"))
    # A cell is used unless its parent also fits, which leaves an odd first and an even last one.
    cells = F.array_compact(
        F.array(
            F.when(F.col("a") % 2 != 0, F.col("a")),
            F.when(F.col("b") % 2 != 0, F.col("b") - 1),
        )
    )
    return (
        ends.select("level", "pos", "label", F.explode(cells).alias("cell"))
        .groupBy("level", "cell")
        .agg(F.min_by(F.struct("pos", "label"), "pos").alias("hit"))
    )


def _by_tree(rows: DataFrame, padded: DataFrame, default: str) -> DataFrame:
    cells = window_cells(padded)
    used = cells.groupBy("level").count().orderBy("level").toArrow().to_pydict()  # <= 41 rows
    if sum(used["count"]) <= CELL_LIMIT:
        return _by_cells(rows, cells, used["level"], default)
    return _by_second(rows, cells, used["level"], default)


def _by_cells(rows: DataFrame, cells: DataFrame, levels: list[int], default: str) -> DataFrame:
    """One broadcast lookup per level, cells being few (counted): the rows stay where they are."""
    # brought over once, instead of cutting the windows again for every level
    few = rows.sparkSession.createDataFrame(cells.toArrow())
    hits = []
    for level in levels:
        side = F.broadcast(
            few.where(F.col("level") == level).select(
                F.col("cell").alias("_cell"), F.col("hit").alias(f"_hit{level}")
            )
        )
        here = F.shiftright("_epoch", level)
        rows = rows.join(side, here == F.col("_cell"), "left").drop("_cell")
        hits.append(F.col(f"_hit{level}"))
    first = F.array_min(F.array_compact(F.array(*hits)))  # structs order by pos
    names = [f"_hit{level}" for level in levels]
    return rows.withColumn("label", F.coalesce(first["label"], F.lit(default))).drop(*names)


def _by_second(rows: DataFrame, cells: DataFrame, levels: list[int], default: str) -> DataFrame:
    """Shuffled lookup for window tables beyond broadcast size. Labels depend on the whole second
    only, so each distinct second is looked up once and the result joined back; it is unique per
    second, and a busy second is split by AQE on the row side."""
    seconds = rows.select("_epoch").where(F.col("_epoch").isNotNull()).distinct()
    probes = seconds.select(
        "_epoch", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    ).withColumn("cell", F.expr("shiftright(_epoch, level)"))
    # cells are unique per (level, cell): at most one match per probe
    labels = (
        probes.join(cells, ["level", "cell"])
        .groupBy("_epoch")
        .agg(F.min_by("hit.label", "hit.pos").alias("label"))
    )
    return rows.join(labels, "_epoch", "left").withColumn(
        "label", F.coalesce("label", F.lit(default))
    )


def label_dataset(
    features: DataFrame, windows: DataFrame, ts: str = "timestamp", **kw
) -> DataFrame:
    """Label feature rows by their time column (timestamp or ISO text)."""
    moment = F.col(ts)
    if features.schema[ts].dataType.simpleString() == "string":
        moment = parse_iso(moment)
    return label_by_windows(features, windows, epoch=epoch_seconds(moment), **kw)


def label_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and non-normal rows; any label other than ``normal`` counts as non-normal."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(label) != DEFAULT_LABEL).alias("anomalous_rows"),
    )
