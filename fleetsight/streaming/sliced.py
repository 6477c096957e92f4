"""Trust over a stream in two levels, for nodes of any share of the rows.

A node's rows of a micro-batch are cut into slices of time. The first level, keyed by (node, slice), puts a
slice's rows in order and composes their score steps into prefix maps and one map for the slice. The
second, keyed by node, holds the score and strings slices together: one row per slice. Last, the rows of
each slice get their scores from its start, again spread by (node, slice).

What passes a node's own task is a row per slice, whose rows are packed and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetsight.operators.trust import V1, TrustPolicy, status_transitions
from fleetsight.plans.ordered import compose_prefixes

_PACKED = "node STRING, slice LONG, delta DOUBLE, lo DOUBLE, hi DOUBLE, tampered BOOLEAN, n LONG, task INT, rows BINARY"


class _SliceProcessor(StatefulProcessor):
    """The rows of one slice in one micro-batch, in order, with the map from the slice's start to each."""

    def __init__(self, policy: TrustPolicy, order: Sequence[str]):
        self.policy, self.order = policy, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        self.task = context.partitionId() if context else -1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        p = self.policy
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        bad = pdf["tampered"].fillna(False).to_numpy(dtype=bool)
        anomaly = pdf["is_anomaly"].fillna(False).to_numpy(dtype=bool)
        delta = np.where(bad, 0.0, np.where(anomaly, -p.decay, p.recovery))
        delta, lo, hi = compose_prefixes(delta, np.where(bad, 0.0, p.lo), np.where(bad, 0.0, p.hi))
        pdf = pdf.drop(columns=["slice"]).assign(_delta=delta, _lo=lo, _hi=hi, _bad=np.logical_or.accumulate(bad))
        table = pa.Table.from_pandas(pdf, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        cells = {"delta": delta[-1], "lo": lo[-1], "hi": hi[-1], "tampered": bool(bad.any()), "n": len(pdf), "task": self.task}
        packed = sink.getvalue().to_pybytes()
        yield pd.DataFrame({"node": [key[0]], "slice": [key[1]], **{k: [v] for k, v in cells.items()}, "rows": [packed]})

    def close(self) -> None:
        pass


class _StartProcessor(StatefulProcessor):
    """Score and latch at the start of each slice of a node."""

    def __init__(self, policy: TrustPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trust", "score DOUBLE, compromised BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        score, seen = self.state.get() if self.state.exists() else (self.policy.init, False)
        pdf = pd.concat(list(rows)).sort_values("slice", kind="stable")
        starts, latched = [], []
        for d, lo, hi, bad in zip(pdf["delta"], pdf["lo"], pdf["hi"], pdf["tampered"]):
            starts.append(score)
            latched.append(seen)
            score, seen = min(hi, max(lo, score + d)), seen or bool(bad)
        self.state.update((float(score), bool(seen)))
        yield pdf.assign(start=starts, latched=latched)

    def close(self) -> None:
        pass


def _expand(schema: pa.Schema):
    names = [n for n in schema.names if n not in ("task", "prev_score", "score", "prev_compromised", "compromised")]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                rows = pa.ipc.open_stream(column["rows"][i].as_buffer()).read_all().combine_chunks()
                start, seen = column["start"][i].as_py(), column["latched"][i].as_py()
                d, lo, hi = (rows.column(c).to_numpy() for c in ("_delta", "_lo", "_hi"))
                score = np.minimum(hi, np.maximum(lo, start + d))
                latched = rows.column("_bad").to_numpy(zero_copy_only=False) | seen
                made = {
                    "task": np.full(len(score), column["task"][i].as_py(), dtype=np.int32),
                    "prev_score": np.append(start, score[:-1]),
                    "score": score,
                    "prev_compromised": np.append(seen, latched[:-1]).astype(float),
                    "compromised": latched.astype(float),
                }
                cells = [rows.column(n).combine_chunks().cast(schema.field(n).type) for n in names]
                columns = dict(zip(names, cells)) | {n: pa.array(v) for n, v in made.items()}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return expand


def stream_trust_sliced(
    records: DataFrame, policy: TrustPolicy = V1, order: Sequence[str] = ("ts",), slice_s: int = 3_600, ts: str = "ts"
) -> DataFrame:
    """Scored stream (node, is_anomaly, tampered, order columns) -> trust trace with status and action.
    ``order`` begins with ``ts``, the time that slices are cut by. ``task``: the first level's partition.

    Order is event order inside a micro-batch and arrival order between them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = records.withColumn("slice", F.floor(F.unix_micros(ts) / F.lit(slice_s * 1_000_000)).cast("long"))
    packed = rows.groupBy("node", "slice").transformWithStateInPandas(
        statefulProcessor=_SliceProcessor(policy, order), outputStructType=_PACKED, outputMode="append", timeMode="none"
    )
    started = packed.groupBy("node").transformWithStateInPandas(
        statefulProcessor=_StartProcessor(policy),
        outputStructType=f"{_PACKED}, start DOUBLE, latched BOOLEAN",
        outputMode="append",
        timeMode="none",
    )
    made = "task INT, prev_score DOUBLE, score DOUBLE, prev_compromised DOUBLE, compromised DOUBLE"
    schema = T.StructType([*records.schema.fields, *T.StructType.fromDDL(made).fields])
    dealt = started.repartition("node", "slice").select("rows", "start", "latched", "task")
    return status_transitions(dealt.mapInArrow(_expand(to_arrow_schema(schema)), schema), "tampered")
