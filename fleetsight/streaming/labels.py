"""First-match labels on a stream, where scenario windows may arrive after the rows they label.

Rows and windows meet in state cells of ``cell_s`` seconds of event time. A cell's rows are held until the
watermark has passed its end, that is until no window can come any more that is at most ``delay`` behind;
then each gets the label of the first window (lowest ``pos``) that holds its second, as in
``label_by_windows``. How input is cut into micro-batches changes nothing.

A cell's rows are dealt over ``salts`` keys by a hash, so a busy second is no single task; its windows, which
are few, go to each of them. A window is written to all cells it touches: choose ``cell_s`` not much
smaller than a window.

Defined cases: a row of a closed cell comes out at once, without a label and with ``late`` set; a window
that comes behind closed cells comes out as a row of its own for each of them (``late_windows``); so nothing is lost unseen. Rows
without a time get the default label at once. Windows without start, end or ``pos`` or with a padded start
behind the end hold nothing. Cells open when the input ends stay open. Equal rows all come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.operators.labeling import DEFAULT_LABEL, END_PAD, START_PAD, label_by_windows
from fleetsight.plans.grids import BLOCK
from fleetsight.streaming.steps import State, Step, watermarks

# Held rows are JSON text, whatever their columns.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OUT = "row STRING, label STRING, late BOOLEAN, window_pos LONG, window_cell LONG"


def first_labels(epochs: np.ndarray, windows: list[tuple[int, int, int, str | None]], default: str) -> list[str]:
    """Label of each moment by the first of the windows (pos, s, e, label) that holds it."""
    order = np.argsort(epochs, kind="stable")
    moments = epochs[order]
    first = np.full(len(moments), len(windows))
    windows = sorted(windows, key=lambda w: w[:3])
    for i in range(len(windows) - 1, -1, -1):  # earlier windows overwrite later ones
        _, s, e, _ = windows[i]
        first[np.searchsorted(moments, s, "left") : np.searchsorted(moments, e, "right")] = i
    names = [default if w[3] is None else w[3] for w in windows] + [default]
    labels: list[str] = [default] * len(moments)
    for place, i in zip(order.tolist(), first.tolist()):
        labels[place] = names[i]
    return labels


class _LabelProcessor(StatefulProcessor):
    def __init__(self, cell_s: int, default: str):
        self.cell_s, self.default = cell_s, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "epoch LONG, row STRING")
        self.windows = handle.getListState("windows", "pos LONG, s LONG, e LONG, label STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        cell, salt = key
        end_ms = (cell + 1) * self.cell_s * 1000
        closed = end_ms <= timerValues.getCurrentWatermarkInMs()
        for pdf in rows:  # bounded chunks
            held = pdf[pdf["row"].notna()]
            spans = pdf[pdf["row"].isna()]
            if closed:
                if len(held):
                    yield _frame(held["row"], None, True)
                if salt == 0 and len(spans):  # every salt has the window, one tells
                    yield _frame([None] * len(spans), spans["label"], True, spans["pos"], int(cell))
                continue
            if len(held):
                self.rows.appendList([(int(t), r) for t, r in zip(held["epoch"], held["row"])])
            if len(spans):
                cells = zip(spans["pos"], spans["s"], spans["e"], spans["label"])
                self.windows.appendList([(int(p), int(s), int(e), w) for p, s, e, w in cells])
        if not closed:
            self.handle.registerTimer(end_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        windows = [tuple(w) for w in self.windows.get()]
        block: list[tuple[int, str]] = []
        for epoch, row in self.rows.get():
            block.append((epoch, row))
            if len(block) == BLOCK:
                yield self._labeled(block, windows)
                block = []
        if block:
            yield self._labeled(block, windows)
        self.rows.clear()
        self.windows.clear()

    def _labeled(self, block: list[tuple[int, str]], windows: list[tuple]) -> pd.DataFrame:
        labels = first_labels(np.array([t for t, _ in block], dtype=np.int64), windows, self.default)
        return _frame([row for _, row in block], labels, False)

    def close(self) -> None:
        pass


def _frame(rows, labels, late: bool, pos=None, cell: int | None = None) -> pd.DataFrame:
    rows = list(rows)
    whole = pd.Series([None] * len(rows) if pos is None else list(pos), dtype="Int64")
    named = pd.Series([None] * len(rows) if labels is None else list(labels), dtype=object)
    cells = pd.Series([cell] * len(rows), dtype="Int64")
    text = pd.Series(rows, dtype=object)
    return pd.DataFrame({"row": text, "label": named, "late": late, "window_pos": whole, "window_cell": cells})


def stream_labels(
    rows: DataFrame,
    windows: DataFrame,
    delay: str,
    cell_s: int = 3600,
    salts: int = 8,
    start_pad: int = START_PAD,
    end_pad: int = END_PAD,
    epoch: str | Column = "epoch",
    default: str = DEFAULT_LABEL,
) -> DataFrame:
    """Two streams, rows and windows (start_time, end_time, label, pos; seconds) -> (row, label, late,
    window_pos, window_cell). ``row`` holds the row's columns as a struct; it is null in the rows that report windows
    behind closed cells. ``labeled_rows`` and ``late_windows`` take the output apart."""
    if cell_s <= 0 or salts <= 0:
        raise ValueError("cell_s and salts must be positive")
    moment = (F.col(epoch) if isinstance(epoch, str) else epoch).cast("bigint")
    schema = rows.schema
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _JSON)
    none = F.lit(None)
    held = rows.select(moment.alias("epoch"), packed.alias("row"))
    timed = held.where(F.col("epoch").isNotNull()).select(
        F.timestamp_seconds("epoch").alias("at"),
        F.floor(F.col("epoch") / cell_s).cast("long").alias("cell"),
        F.pmod(F.xxhash64("row", "epoch"), F.lit(salts)).cast("int").alias("salt"),
        "epoch",
        "row",
        *[none.cast(t).alias(c) for c, t in (("pos", "long"), ("s", "long"), ("e", "long"), ("label", "string"))],
    )
    padded = windows.select(
        (F.col("start_time") + start_pad).cast("long").alias("s"),
        (F.col("end_time") + end_pad).cast("long").alias("e"),
        F.col("label").cast("string").alias("label"),
        F.col("pos").cast("long").alias("pos"),
    ).where("s <= e AND pos IS NOT NULL")
    touched = padded.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("s") / cell_s).cast("long"), F.floor(F.col("e") / cell_s).cast("long")))
    ).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    spans = touched.select(
        F.timestamp_seconds("s").alias("at"), "cell", "salt",
        none.cast("long").alias("epoch"), none.cast("string").alias("row"), "pos", "s", "e", "label",
    )
    # Only the stream's watermark is used, not its filter: that looks at columns of event time.
    both = timed.unionByName(spans).withWatermark("at", delay).drop("at")
    closed = both.groupBy("cell", "salt").transformWithStateInPandas(
        statefulProcessor=_LabelProcessor(cell_s, default), outputStructType=_OUT, outputMode="append", timeMode="eventTime"
    )
    untimed = held.where(F.col("epoch").isNull()).select(
        "row", F.lit(default).alias("label"), F.lit(False).alias("late"),
        none.cast("long").alias("window_pos"), none.cast("long").alias("window_cell"),
    )
    return closed.unionByName(untimed).withColumn("row", F.from_json("row", schema, _JSON))


LABEL_TABLES = ("rows", "windows", "clock")


def label_input(
    rows: DataFrame, windows: DataFrame, start_pad: int = START_PAD, end_pad: int = END_PAD, epoch: str | Column = "epoch"
) -> DataFrame:
    """The two streams as one (row, epoch, window), as ``label_step`` takes them."""
    moment = (F.col(epoch) if isinstance(epoch, str) else epoch).cast("bigint")
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), moment.alias("epoch"))
    s, e = ((F.col(c) + pad).cast("long") for c, pad in (("start_time", start_pad), ("end_time", end_pad)))
    padded = windows.select(
        F.struct(s.alias("start_time"), e.alias("end_time"), F.col("label").cast("string").alias("label"), F.col("pos").cast("long").alias("pos")).alias("window")
    ).where("window.start_time <= window.end_time AND window.pos IS NOT NULL")
    none = F.lit(None)
    held = held.withColumn("window", none.cast(padded.schema["window"].dataType))
    return held.unionByName(padded.select(none.cast(held.schema["row"].dataType).alias("row"), none.cast("long").alias("epoch"), "window"))


def label_step(delay: str, cell_s: int = 3600, default: str = DEFAULT_LABEL) -> Step:
    """As ``stream_labels``, for ``stream_steps`` over ``label_input``: rows of open cells and the windows that
    may still hold some are state tables, and closed cells are labeled by ``label_by_windows``."""
    if cell_s <= 0:
        raise ValueError("cell_s must be positive")

    def step(batch: DataFrame, before: State) -> tuple[DataFrame, State]:
        moment = F.coalesce("epoch", "window.start_time") * 1_000_000
        old, new, clock = watermarks(batch.select(moment.alias("us")), before, delay)
        no, none = F.lit(False), F.lit(None)

        def cell(time: Column) -> Column:
            return F.floor(time / cell_s).cast("long")

        def out(rows: DataFrame, label: Column, late: Column, pos: Column = none, at: Column = none) -> DataFrame:
            return rows.select(
                "row", label.cast("string").alias("label"), late.alias("late"), pos.cast("long").alias("window_pos"),
                at.cast("long").alias("window_cell"),
            )

        end_ms = (cell(F.col("epoch")) + 1) * (cell_s * 1000)
        rows = batch.where("row IS NOT NULL").select("row", "epoch")
        spans = batch.where("window IS NOT NULL")
        untimed = out(rows.where("epoch IS NULL"), F.lit(default), no)
        behind = out(rows.where(end_ms <= old), none, F.lit(True))
        first, last = cell(F.col("window.start_time")), F.least(cell(F.col("window.end_time")), F.lit(old // (cell_s * 1000) - 1))
        missed = spans.where(first <= last).withColumn("cell", F.explode(F.sequence(first, last)))
        told = out(missed, F.col("window.label"), F.lit(True), F.col("window.pos"), F.col("cell"))

        live, windows = rows.where(end_ms > old), spans.select("window.*")
        if before:
            live, windows = live.unionByName(before["rows"]), windows.unionByName(before["windows"])
        closed = label_by_windows(live.where(end_ms <= new), windows, 0, 0, default=default)
        found = out(closed, F.col("label"), no).unionByName(behind).unionByName(told).unionByName(untimed)
        needed = windows.where((cell(F.col("end_time")) + 1) * (cell_s * 1000) > new)
        return found, {"rows": live.where(end_ms > new), "windows": needed, "clock": clock}

    return step


def labeled_rows(found: DataFrame) -> DataFrame:
    """The rows with their labels; those that came behind their closed cell have none."""
    return found.where(F.col("window_pos").isNull()).select("row.*", "label", "late")


def late_windows(found: DataFrame) -> DataFrame:
    """(pos, label, cell): windows that came when this cell of theirs was closed."""
    return found.where(F.col("window_pos").isNotNull()).select(
        F.col("window_pos").alias("pos"), "label", F.col("window_cell").alias("cell")
    )
