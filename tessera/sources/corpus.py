"""Reading corpora and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column_or(df: DataFrame, name: str, default: str = "") -> Column:
    """The column as text with nulls filled, or the default where the table has no such column."""
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def whole_texts(spark: SparkSession, paths: str) -> DataFrame:
    """path and text of whole files; broken UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def code_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as a labelled code corpus: a tenth is for validation, a tenth for test.

    The raw labels, languages and patches that a code corpus would bring are
    derived from the ids, so that every operator has all its cases.
    """
    raw = ["CWE-89", "cwe-79 ", "CWE-94", "CWE-502", "CWE-20", "CWE-200", "CWE-476", "CWE-119", "CWE-787", "CWE-125", "CWE-999", "nan", None]
    docs = table(spark, folder, "documents")
    k = F.col("doc_id")
    split = F.when(k % 10 == 8, "validation").when(k % 10 == 9, "test").otherwise("train")
    cwe = F.get(F.array(*[F.lit(x) for x in raw]), (k % len(raw)).cast("int"))
    fixed = F.when(k % 4 == 0, F.col("text")).when(k % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit("fixed "), "text"))
    return docs.select(k.alias("row_id"), split.alias("split"), F.col("text").alias("code"), (k % 3 == 0).alias("is_vulnerable"), cwe.alias("cwe_id"), fixed.alias("code_fixed"), F.when(k % 7 == 0, "C++").otherwise(F.col("lang")).alias("language"), "source")


def write_json(df: DataFrame, path: str, sampled: bool = False) -> str:
    """Write a result as JSON lines; a sampled run goes beside the canonical file, never over it."""
    to = f"{path}_sampled" if sampled else path
    df.write.mode("overwrite").json(to)
    return to
