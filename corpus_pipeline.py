"""The corpus pipeline: quality, near copies, benchmark passages, mixture, shards.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` applies them to the documents of ``sf_dir`` and
writes each stage's rows once, in the shared folder, so that a lost executor repeats one stage at most.

1. quality: rows that the classifier predicts good stay (labels train it; it never looks at labels,
   lang, source or id when it scores).
2. near_copies: of each component of linked documents the one with the smallest id stays.
3. decontamination: rows with a word inside a benchmark window go.
4. mixture: rows are repeated or left out so that the sources reach their target weights.
5. shards: every row gets its shard.

Defined cases are those of the operators; in addition, other columns may have any name and come out as
given (but those named like the ones shards adds, which it replaces), documents without an id are all kept by
near_copies, as they link with nothing; of rows with one id and equal or linked sets one stays, and
unlike rows under one id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.columns import set_aside
from fleetsight.llm.decontamination import find_contamination
from fleetsight.llm.jaccard_join import link_documents
from fleetsight.llm.mixing import mix_sources, repeat_taken
from fleetsight.llm.quality import held_out, keep_good, train_quality
from fleetsight.llm.sharding import shard_rows
from fleetsight.llm.store import stored
from fleetsight.session import ship_code

ship_code()

# The columns that stages look at. All others are carried along under working names.
USED = ("doc_id", "text", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return keep_good(docs, train_quality(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, own = set_aside(docs, *USED)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").head(1):
        return _apart(given).select(own)
    gone = link_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return given.join(gone, "doc_id", "left_anti").select(own)


def _apart(docs: DataFrame) -> DataFrame:
    """near_copies where ids repeat: every (doc_id, text) links under a number of its own, so that a row
    goes only for a set equal or linked to its own."""
    rows = docs.withColumn("__text", F.md5(F.coalesce("text", F.lit(""))))
    names = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "__text").agg(F.count(F.lit(1)).alias("__rows"))
    names = stored(names.withColumn("__id", F.monotonically_increasing_id()), "names")
    named = rows.join(names, ["doc_id", "__text"])
    texts = stored(named.select("__id", "text"), "named")
    linked = link_documents(texts, "__id").distinct().withColumnRenamed("doc_id", "__id")
    # Empty sets link with nothing; under one id they are equal.
    empty = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    first = F.min(F.struct("doc_id", "__text", "__id"))
    heads = names.join(linked, "__id").groupBy(empty.alias("empty"), group.alias("group")).agg(first.alias("first"))
    left = named.join(stored(heads.select("first.__id"), "heads"), "__id", "left_semi")
    one = left.where("__rows > 1").dropDuplicates(["__id"])
    parts = (left.where("__rows = 1"), one, rows.where("doc_id IS NULL"))
    once, one, without = (p.select(docs.columns) for p in parts)
    return once.unionByName(one).unionByName(without)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    given, own = set_aside(docs, *USED)
    return find_contamination(given, benchmark, keep_text=True).where("n_hit = 0").select(own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, own = set_aside(docs, *USED)
    return repeat_taken(mix_sources(given)).select(own)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

# A fitted classifier has no SQL form; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
