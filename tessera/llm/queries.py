"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lm_score, packing, pii, quality, sharding, simhash, token_counts, toxicity, warc
from tessera.llm._common import run_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under an n-gram model of those that aren't held out."""
    return lm_score.score(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level BPE, through a digest cache."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(documents(spark, sf_dir), path, run_dir(spark, "token-counts"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    out = sharding.shard_by_bytes(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which items of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(documents(spark, sf_dir), items).drop("score")


# the same overlap by plain shingle joins over whole documents
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 2)), lambda i: array_to_string({0}[i:i + 4], ' ')))"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_GRAMS.format("w")} AS g FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
b AS (SELECT item_id, w, w[1:(len(w) + 1) // 2] AS q, w[(len(w) + 1) // 2 + 1:] AS a FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT item_id, 'w' AS part, {_GRAMS.format("w")} AS g FROM b UNION ALL SELECT item_id, 'q', {_GRAMS.format("q")} FROM b UNION ALL SELECT item_id, 'a', {_GRAMS.format("a")} FROM b),
pg AS (SELECT item_id, part, len(g) AS n, unnest(g) AS s FROM p),
dg AS (SELECT doc_id, unnest(g) AS s FROM d),
hit AS (SELECT doc_id, item_id, part, count(*) / any_value(n) AS share FROM pg JOIN dg USING (s) GROUP BY ALL),
ok AS (SELECT doc_id, item_id FROM hit GROUP BY ALL HAVING max(share) FILTER (part = 'w') >= 0.8 AND max(share) FILTER (part = 'q') >= 0.5 AND max(share) FILTER (part = 'a') >= 0.5),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM ok GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN o USING (doc_id)
"""


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents."""
    return quality.line_quality(documents(spark, sf_dir)).drop("lost", "cleaned")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPACE = r"[\x20\x09-\x0D]+"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {_sql(_SPACE)}), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
f AS (SELECT *, list_filter(lines, lambda x: NOT (
          regexp_matches(x, {_sql(quality.NAVIGATION)}) OR length(x) < 40 AND regexp_matches(x, {_sql(quality.MENU)}) OR regexp_matches(x, {_sql(quality.BOILERPLATE)})
          OR len(regexp_extract_all(x, {_sql(quality.NOISY)})) * 3 > len(regexp_extract_all(x, {_sql(quality.WORD)}))
          OR (right(x, 1) <> '.' AND len(regexp_extract_all(x, {_sql(quality.WORD)})) BETWEEN 1 AND 2 AND NOT regexp_matches(x, {_sql(quality.CLOSED)})))) AS good,
      list_filter(lines, lambda x: regexp_matches(x, {_sql(quality.WORD)})) AS worded FROM w),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT f.doc_id, len(words) AS n_words, length(regexp_replace(t, {_sql(_SPACE)}, '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(worded) - len(list_distinct(worded)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      length(regexp_replace(array_to_string(good, chr(10)), {_sql(_SPACE)}, '', 'g')) AS good_chars,
      len(regexp_extract_all(array_to_string(good, chr(10)), {_sql(quality.WORD)})) AS good_words
      FROM f LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 - good_chars / greatest(word_chars, 1) <= {quality.MAX_LOST} AND good_words >= {quality.MIN_WORDS} AS kept
FROM b
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along a Hilbert curve."""
    out = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_token_counts, op3_simhash, op4_sharding, op5_pii, op6_warc, op7_decontaminate, op8_line_quality, op9_packing, op10_toxicity)}
SQL = {"op6_warc": OP6_SQL, "op7_decontaminate": OP7_SQL, "op8_line_quality": OP8_SQL}
