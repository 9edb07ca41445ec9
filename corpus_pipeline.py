"""The training-data pipeline: documents in, packed sequences out.

STAGES are applied in order; each reads all that the one before kept. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_copies, packing, pii, simhash, toxicity
from tessera.llm._common import WIDE_ROWS, few, run_dir, written


def gathered(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a stage in as many partitions as the documents before it need, however many small ones they came in."""
    return few(out, docs.count(), WIDE_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay; null and empty texts do."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return gathered(scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; SimHash finds near copies, verified at a similarity of 0.8 of their five-word shingles, and min-hash bands the rest of them."""
    return gathered(simhash.keep_one(docs, classes=near_copies.classes(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contaminated_pairs(docs, items)
    return gathered(found.where(F.size(found.columns[-1]) == 0).select(*docs.columns), docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with personal data masked and n_chars brought up to date."""
    return gathered(pii.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    return gathered(out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("packing", pack),
]

#: Models, hashes and tokenizers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), run_dir(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
