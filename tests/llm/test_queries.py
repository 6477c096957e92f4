"""The registered queries against their SQL twins, and the pipeline against a brute-force version."""

import pytest
from helpers import documents
from pyspark.sql import functions as F
from test_layout import shards as split_shards
from test_layout import targets
from test_similarity import components
from test_text_operators import contamination

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import compare, connect
from fleetsight.llm import mixing, quality, sharding
from fleetsight.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message, _ = compare(spark, duck, SF, name)
    assert ok, message


def test_entry_has_all():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out())
    good = quality.score_quality(docs, quality.train_quality(docs, labels)).where("score >= 0.7").collect()
    component = components([(r.doc_id, r.text) for r in good])
    single = [r for r in good if component[r.doc_id] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {i for i, _, hit, _ in contamination([(r.doc_id, r.text) for r in single], items) if hit}
    clean = [r for r in single if str(r.doc_id) not in dirty]
    assert len(good) < docs.count() and len(clean) < len(single) < len(good)
    size = {r.doc_id: len(r.text.split()) for r in clean}
    by_source = {}
    for r in clean:
        by_source[r.source] = by_source.get(r.source, 0) + size[r.doc_id]
    want = targets(by_source)

    got = corpus_pipeline.run(spark, SF)
    assert got.columns[: len(columns)] == columns
    rows = got.collect()
    assert {r.doc_id for r in rows} <= set(size)
    assert {r.source for r in rows} == set(by_source)
    largest = max(size.values())
    for s in by_source:
        assert abs(sum(size[r.doc_id] for r in rows if r.source == s) - want[s]) <= largest / 2 + 1
    texts = {r.doc_id: r for r in clean}
    assert all(r.text == texts[r.doc_id].text and r.lang == texts[r.doc_id].lang for r in rows)
    hashed = got.select("doc_id", "n_bytes", sharding.row_hash([got[c] for c in columns])).collect()
    assert {r.doc_id: r.shard for r in rows} == split_shards([tuple(r) for r in hashed], sharding.SHARD_BYTES)
    assert got.select(mixing.word_count("text").alias("n")).where("n = 0").count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (1, "a b", "en", "s", 3), (None, "c d", None, "s", 3), (2, "", "en", None, 0)],
        "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    )
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            if name != "shards":
                assert out.columns == docs.columns, name
            assert out.count() <= 2 * some.count(), name


def test_stages_keep_clashing_columns(spark):
    """Columns named like what a stage works with come out with the values given."""
    clashing = "target taken source_size cut_part epochs hit items item_ids n_words predicted __chars h shard_x".split()
    docs = documents(spark).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(0))) for c in clashing})
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "shards":  # replaces the given ``part``
            assert out.columns == [c for c in docs.columns if c != "part"] + ["n_bytes", "shard", "part", "shard_bytes"]
            out, all_of = out.select(*clashing, "score"), {tuple(r) for r in docs.select(*clashing, "score").collect()}
        else:
            assert out.columns == docs.columns, name
            all_of = given
        rows = [tuple(r) for r in out.collect()]
        assert rows or name == "quality", name
        assert set(rows) <= all_of, name
    model = quality.Ensemble(10.0)  # everything is good
    assert {tuple(r) for r in quality.keep_good(docs, model).collect()} == given


def test_near_copies_of_repeated_ids(spark):
    """Unlike texts under one id are judged apart; equal ones leave one row."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, b.upper()), (4, None), (4, ""), (5, ""), (None, a), (None, a)]
    got = corpus_pipeline.near_copies(spark, documents(spark, rows), SF)
    assert got.columns == documents(spark, rows).columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == [
        ("1", a), ("2", b), ("3", c), ("4", ""), ("5", ""), ("None", a), ("None", a),
    ]
