"""Every registered query against its SQL twin, with whole and with split keys."""

import pytest

import __spark_entry__ as entry
from fleetsight.registry import ORACLES, QUERIES
from check_oracles import compare, connect
from fleetsight.plans.ordered import ROWS_PER_CHUNK_CONF

SF = "/root/testdata/sf0.001"
ORDERED = (
    "counter_rate instant_rate eval_grid asof_latest make_sequences sequence_mae series_for_plot "
    "plot_series trust_v1 status_transitions latch hysteresis detect_trust_v1 stream_trust stream_detect"
).split()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, message, _ = compare(spark, duck, SF, name)
    assert ok, message


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_split_keys(spark, duck, name):
    spark.conf.set(ROWS_PER_CHUNK_CONF, "30")
    try:
        ok, message, _ = compare(spark, duck, SF, name)
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert ok, message


def test_every_exact_query_has_a_twin():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {
        "detect_trust_v2",
        "iforest_scores",
        "train_record_detector",
        "reconstruction_scores",
        "augment_noise",
        "stream_sequence_losses",
    }


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"node", "score", "status"} <= set(rows[0].asDict())
