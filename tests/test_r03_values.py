"""Division by zero between metrics, and losses that lie at a threshold."""

import math

import numpy as np
from pyspark.sql import functions as F

from fleetsight.operators import vectors as vec
from fleetsight.operators.reconstruct import Reconstruction


def test_a_total_of_zero_loses_no_row(spark):
    """Every key with all metrics gives a row; as in a metric store the share is infinite there."""
    rows = [("a", "mem_available", 3.0), ("a", "mem_total", 0.0), ("b", "mem_available", 0.0), ("b", "mem_total", 0.0)]
    rows += [("c", "mem_available", 1.0), ("c", "mem_total", 4.0), ("d", "mem_available", 1.0)]
    samples = spark.createDataFrame(rows, "node STRING, metric STRING, value DOUBLE")
    names = ("mem_available", "mem_total")
    found = vec.combine_vectors(samples, names, vec.memory_used_share(), keys=["node"])
    got = {r.node: r.value for r in found.select("node", F.round("value", 6).alias("value")).collect()}
    assert got["a"] == -math.inf and math.isnan(got["b"]) and got["c"] == 0.75 and set(got) == {"a", "b", "c"}


def test_losses_add_up_in_the_order_of_the_sequence():
    """Cents that sum to the threshold: whatever the batch, the verdict is that of plain addition."""
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 200, (20_000, 20)), 2)
    model = Reconstruction(np.full(20, 0.5), np.eye(20)[:, :8])
    want = []
    for row in x:
        total = 0.0
        for v in row[8:]:
            total += abs(v - 0.5)
        want.append(total / 20)
    assert model.loss(x).tolist() == want
    assert [float(model.loss(x[i : i + 1])[0]) for i in range(200)] == want[:200]
