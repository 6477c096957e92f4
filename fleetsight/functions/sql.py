"""The record functions under names that SQL text can use.

``register_functions`` adds to a session

* ``verify_line(raw)``: is the signature of a raw line right (false where it is missing or no JSON object);
* ``record_score(feature, ...)``: score of a record by a fitted forest, features in the forest's order;
* ``sequence_loss(flat)``: reconstruction error of a flattened sequence by a fitted bottleneck;
* ``trust_fold(TABLE(rows) PARTITION BY node ORDER BY (...), decay, recovery)``: the rows with their running
  trust. Rows need ``is_anomaly`` and ``tampered``.

The first three work on Arrow batches. The fold goes through the rows of a partition one by one and holds
a score and a flag; a node's rows are one task's work, so tables with a node of a large share are better
served by ``operators.trust.trust_scores``, which gives the same numbers.

Defined cases: a null feature or sequence has a null score; a null ``is_anomaly`` or ``tampered`` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fleetsight.functions.signing import _canonical, sign_text
from fleetsight.operators.forest import Forest
from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.operators.trust import V1

# Written out, since the schema is made in a worker without a session.
_ADDED = [
    T.StructField("prev_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("prev_compromised", T.BooleanType()),
    T.StructField("compromised", T.BooleanType()),
]


class TrustFold:
    """One instance per partition of the table."""

    def __init__(self):
        self.score, self.seen = V1.init, False

    @staticmethod
    def analyze(rows: AnalyzeArgument, decay: AnalyzeArgument, recovery: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("trust_fold takes a table: trust_fold(TABLE(rows) PARTITION BY node ORDER BY (ts), decay, recovery)")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, *_ADDED]))

    def eval(self, row: Row, decay: float, recovery: float) -> Iterator[tuple]:
        before, seen = self.score, self.seen
        if row["tampered"]:
            self.score, self.seen = 0.0, True
        else:
            step = -float(decay) if row["is_anomaly"] else float(recovery)
            self.score = min(V1.hi, max(V1.lo, before + step))
        yield (*row, before, self.score, seen, self.seen)


def register_functions(
    spark: SparkSession, secret: str | None = None, forest: Forest | None = None, model: Reconstruction | None = None
) -> None:
    """Register ``trust_fold`` and those functions whose parameter is given."""
    if secret is not None:

        @F.pandas_udf("boolean")
        def verify_line(lines: pd.Series) -> pd.Series:
            parts = [_canonical(t, "signature") for t in lines]
            return pd.Series([text is not None and claimed == sign_text(text, secret) for text, claimed in parts], dtype=bool)

        spark.udf.register("verify_line", verify_line)
    if forest is not None:

        @F.pandas_udf("double")
        def record_score(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(dtype=float) for f in features])
            return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, forest.decision(np.nan_to_num(x)))).astype(object).where(lambda s: s.notna(), None)

        spark.udf.register("record_score", record_score)
    if model is not None:

        @F.pandas_udf("double")
        def sequence_loss(rows: pd.Series) -> pd.Series:
            known = rows.notna().to_numpy()
            out = pd.Series([None] * len(rows), dtype=object)
            if known.any():
                out[known] = model.loss(np.stack(rows[known].to_numpy()))
            return out

        spark.udf.register("sequence_loss", sequence_loss)
    spark.udtf.register("trust_fold", F.udtf(TrustFold))
