"""Token counts through a digest cache.

A text's SHA-256 and the tokenizer's version digest key a stored count. Only
texts whose pair of digests isn't stored are encoded, each distinct one once,
and their counts are appended to the cache. The cache is a Parquet table in
the shared folder; equal rows that two jobs appended at once do no harm.

Null texts count as empty ones, repeated rows and null ids stay as they are,
other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import text_of
from tessera.llm._tokens import ByteUnits

CACHE = "content binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def cached(docs: DataFrame, cache_dir: str) -> DataFrame:
    """What the cache holds: one row for each pair of digests."""
    rows = docs.sparkSession.read.schema(CACHE).parquet(cache_dir)
    return rows.groupBy("tokenizer", "content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_dir: str, text: str = "text") -> str:
    """Encode the distinct texts that the cache lacks and append them; returns the tokenizer's digest."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        units = ByteUnits.of(tokenizer_path)
        for b in batches:
            counts = pa.array(units.counts(b.column("t").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("content"), counts], ["content", "n_tokens"])

    # copies go in the map-side half of this aggregation, so a hot text is never gathered
    distinct = docs.select(F.unhex(F.sha2(text_of(text), 256)).alias("content"), text_of(text).alias("t")).groupBy("content").agg(F.first("t").alias("t"))
    stored = cached(docs, cache_dir).where(F.col("tokenizer") == version).select("content")
    misses = distinct.join(stored, "content", "left_anti")
    (
        misses.mapInArrow(encode, "content binary, n_tokens long")
        .withColumn("tokenizer", F.lit(version))
        .write.mode("append").partitionBy("tokenizer").parquet(cache_dir)
    )
    return version


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of every row."""
    version = fill_cache(docs, tokenizer_path, cache_dir, text)
    rows = docs.select(F.col(id_col), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_of(text), 256)).alias("content"))
    counts = cached(docs, cache_dir).where(F.col("tokenizer") == version)
    return rows.join(counts, "content", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
