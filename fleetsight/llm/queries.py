"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.chat_pairs import conversations, format_preferences, swap_last_reply
from fleetsight.llm.chat_repair import damage, repair_conversations, with_digests
from fleetsight.llm.decontamination import find_contamination
from fleetsight.llm.jaccard_join import link_documents
from fleetsight.llm.mixing import mix_sources
from fleetsight.llm.nearest import nearest_neighbours
from fleetsight.llm.packing import pack_documents
from fleetsight.llm.phrases import mine_phrases
from fleetsight.llm.quality import held_out, score_quality, train_quality
from fleetsight.llm.registry import ORACLES, QUERIES, query, table
from fleetsight.llm.sharding import SHARD_BYTES, shard_ids
from fleetsight.llm.suffix_dedup import repeated_spans
from fleetsight.llm.token_counts import count_tokens
from fleetsight.llm.warc import archive_folder, read_archives, write_archives

__all__ = ["ORACLES", "QUERIES"]

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low
  FROM pages
), q AS (
  SELECT *, page_id > low OR page_id IS NULL AND low IS NOT NULL AS again FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN coalesce(again, false) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN low END AS refers_to
FROM q
"""


@query(OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), archive_folder(spark))
    records = read_archives(manifest)
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's digest is wrong")))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
), r AS (
  SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM p
), n AS (
  SELECT *, cap / w AS ratio, (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         SUM(cap) OVER (ORDER BY cap / w, place) - cap AS given,
         SUM(w) OVER () - SUM(w) OVER (ORDER BY cap / w, place) + w AS free
  FROM r
), l AS (
  SELECT *, min(CASE WHEN ratio >= (total - given) / free THEN struct_pack(ratio := ratio, place := place, level := (total - given) / free) END) OVER () AS stop
  FROM n
), t AS (
  SELECT source, source_size,
         CASE WHEN stop IS NULL OR (ratio, place) < (stop.ratio, stop.place) THEN cap ELSE least(cap, stop.level * w) END AS target
  FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), g AS (
  SELECT source, key, doc_id, size, count(*) AS c FROM d GROUP BY ALL
), o AS (
  SELECT *, CAST(sum(size * c) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS BIGINT) - size * c AS begin FROM g
)
SELECT o.doc_id, o.size, b.source_size, b.target,
       CAST(epochs * size + greatest(0, least(size, floor((CAST(floor(target) AS BIGINT) - epochs * source_size - begin) / c))) AS BIGINT) AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source, LATERAL (SELECT unnest(range(c)))
"""


@query(OP3_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || chr(31) || coalesce(text, '\N')), 1, 15) AS BIGINT) AS h
  FROM documents
), x AS (
  SELECT r, b, h >> (60 - b) AS p, h, n_bytes FROM d, (SELECT unnest(range(0, 61)) AS b)
), s AS (
  SELECT b, p, CAST(sum(n_bytes) AS BIGINT) AS bytes, min(h) AS lo, max(h) AS hi FROM x GROUP BY b, p
), c AS (
  SELECT r, min(struct_pack(b := x.b, p := x.p, bytes := bytes)) AS c FROM x JOIN s USING (b, p)
  WHERE bytes <= {SHARD_BYTES} OR lo = hi GROUP BY r
)
SELECT doc_id, n_bytes, CASE WHEN c.b = 0 THEN '' ELSE lpad(CAST(bin(c.p) AS VARCHAR), CAST(c.b AS INTEGER), '0') END AS shard,
       CAST(0 AS BIGINT) AS part, c.bytes AS shard_bytes
FROM d JOIN c USING (r)
"""


@query(OP8_SQL)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


TOKEN_LIMIT = 4096


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def _lower(col: str) -> str:
    return f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), words AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS i FROM m
), nh AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN it USING (r)
"""


@query(OP9_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_RENDER = r"""'<|' || replace(replace(t.role, '<|', '< |'), '|>', '| >') || '|>' || chr(10)
         || replace(replace(t.text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10)"""
_MASK = r"""repeat('0', length(replace(replace(t.role, '<|', '< |'), '|>', '| >')) + 5)
         || repeat(CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END, length(replace(replace(t.text, '<|', '< |'), '|>', '| >')) + 7) || '0'"""

OP10_SQL = f"""
WITH c AS (
  SELECT conv_id AS id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}}
           ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), m AS (
  SELECT *, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i END)) AS at FROM c
), p AS (
  SELECT m.id, m.t AS a, CASE WHEN m.at IS NULL THEN m.t
           ELSE list_concat(m.t[1:m.at - 1], CASE WHEN o.at IS NULL THEN m.t[1:0] ELSE o.t[o.at:o.at] END, m.t[m.at + 1:]) END AS b
  FROM m LEFT JOIN m o ON o.id = xor(m.id, 1)
), n AS (
  SELECT *, coalesce(list_min(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[i] <> b[i] THEN i END)) - 1,
                     least(len(a), len(b))) AS n
  FROM p
), r AS (
  SELECT id, n, array_to_string(list_transform(a[1:n], lambda t: {_RENDER}), '') AS prompt,
         array_to_string(list_transform(a[n + 1:], lambda t: {_RENDER}), '') AS chosen,
         array_to_string(list_transform(a[n + 1:], lambda t: {_MASK}), '') AS chosen_mask,
         array_to_string(list_transform(b[n + 1:], lambda t: {_RENDER}), '') AS rejected,
         array_to_string(list_transform(b[n + 1:], lambda t: {_MASK}), '') AS rejected_mask
  FROM n
)
SELECT id AS conv_id, CAST(n AS INTEGER) AS n_prompt_turns, sha256(prompt) AS prompt_sha256,
       sha256(chosen) AS chosen_sha256, sha256(chosen_mask) AS chosen_mask_sha256,
       sha256(rejected) AS rejected_sha256, sha256(rejected_mask) AS rejected_mask_sha256,
       CAST(length(replace(chosen_mask, '0', '')) AS BIGINT) AS chosen_loss_chars,
       CAST(length(replace(rejected_mask, '0', '')) AS BIGINT) AS rejected_loss_chars
FROM r
"""


@query(OP10_SQL)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = conversations(table(spark, sf_dir, "conversations"), "conv_id")
    pairs = format_preferences(*swap_last_reply(talks))
    sha = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")]
    loss = [F.length(F.replace(f"{c}_mask", F.lit("0"), F.lit(""))).cast("long").alias(f"{c}_loss_chars") for c in ("chosen", "rejected")]
    return pairs.select(F.col("id").alias("conv_id"), "n_prompt_turns", *sha, *loss)


@query()
def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks)


OP12_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, j, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS j) WHERE j < k) GROUP BY ALL
), s AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, cut,
         CAST(1000::HUGEINT * c.f * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
  JOIN t ON t.lang = c.lang
  LEFT JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.most IS NULL OR 100 * i.most < 100 * c.f
), weakest AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query(OP12_SQL)
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("text", "lang"))


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return with_digests(*repair_conversations(turns, damage(turns)))
