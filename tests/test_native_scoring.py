"""Scores by built-in functions equal those of the Arrow batches, with no Python worker in the plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight import adapters as ad
from fleetsight.operators.forest import fit_iforest
from fleetsight.operators.reconstruct import Reconstruction
from fleetsight.operators.scaling import standard_scale

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("trees,sample", [(100, 256), (1, 1), (3, 2)])
def test_fitted_forest(spark, trees, sample):
    scaled = standard_scale(ad.forest_items(spark, SF), ad.FOREST_FEATURES).persist()
    forest = fit_iforest(scaled, ad.FOREST_FEATURES, ad.FOREST_ID, trees=trees, sample=sample)
    native = scaled.select(forest.score_expression().alias("a"))
    plan = _plan(native)
    assert "Python" not in plan and "Arrow" not in plan and "from_json" not in plan  # constants were folded
    both = scaled.select(forest.score_expression().alias("a"), forest.score_column().alias("b"))
    worst, n, unlike = both.agg(F.max(F.abs(F.col("a") - F.col("b"))), F.count("a"), F.count_if(F.col("a").isNull())).first()
    assert worst < 1e-12 and n == scaled.count() and unlike == 0


def test_missing_features_score_null(spark):
    scaled = standard_scale(ad.forest_items(spark, SF), ad.FOREST_FEATURES)
    forest = fit_iforest(scaled, ad.FOREST_FEATURES, ad.FOREST_ID, trees=2, sample=8)
    holes = scaled.limit(3).withColumn(ad.FOREST_FEATURES[0], F.lit(None).cast("double"))
    assert [r[0] for r in holes.select(forest.score_expression()).collect()] == [None] * 3


def test_bottleneck(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 12))
    model = Reconstruction(rng.normal(size=12), np.linalg.qr(rng.normal(size=(12, 4)))[0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i INT, x ARRAY<DOUBLE>")
    native = df.select("i", model.loss_expression(F.col("x")).alias("loss"))
    assert "Python" not in _plan(native) and "from_json" not in _plan(native)
    got = [r.loss for r in native.orderBy("i").collect()]
    assert np.allclose(got, model.loss(x), rtol=0, atol=1e-12)
    assert spark.range(1).select(model.loss_expression(F.lit(None).cast("array<double>"))).first()[0] is None
