"""The functions as SQL text calls them, on odd rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from fleetsight.functions.signing import sign_text
from fleetsight.functions.sql import register_functions
from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.registry.models import _given_forest


def test_verify_line(spark):
    register_functions(spark, secret="s")
    body = '{"a": 1.5, "b": "x"}'
    good = body[:-1] + f', "signature": "{sign_text(body, "s")}"}}'
    lines = [good, good.replace("1.5", "1.6"), body, "5", None, '{"signature": 3}']
    rows = spark.createDataFrame(list(enumerate(lines)), "i INT, raw STRING")
    got = spark.sql("SELECT i, verify_line(raw) AS ok FROM {r} ORDER BY i", r=rows).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False]


def test_scores_of_missing_values(spark):
    register_functions(spark, forest=_given_forest(), model=Reconstruction(np.zeros(3), np.eye(3)[:, :1]))
    got = spark.sql("SELECT record_score(1D, 2D, CAST(NULL AS DOUBLE), 0D) AS a, record_score(1D, 2D, 0D, 0D) AS b").first()
    assert got.a is None and got.b is not None
    rows = spark.createDataFrame([(0, [5.0, 1.0, -2.0]), (1, None)], "i INT, x ARRAY<DOUBLE>")
    assert [r.v for r in spark.sql("SELECT sequence_loss(x) AS v FROM {r} ORDER BY i", r=rows).collect()] == [1.0, None]


def test_trust_fold(spark):
    register_functions(spark)
    rows = [("a", 1, True, False), ("a", 2, None, None), ("b", 1, False, True), ("b", 2, False, False), ("b", 3, True, False)]
    frame = spark.createDataFrame(rows, "node STRING, at INT, is_anomaly BOOLEAN, tampered BOOLEAN")
    got = spark.sql("SELECT * FROM trust_fold(TABLE(SELECT * FROM {r}) PARTITION BY node ORDER BY (at), 10.0D, 3.0D) ORDER BY node, at", r=frame)
    assert [(r.prev_score, r.score, r.compromised) for r in got.collect()] == [
        (100.0, 90.0, False), (90.0, 93.0, False), (100.0, 0.0, True), (0.0, 3.0, True), (3.0, 0.0, True),
    ]
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM trust_fold(1, 10.0D, 3.0D)").collect()
