import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 997} thing{i % 13}," for i in range(20_000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, non-ASCII and control characters, and columns whose names operators use themselves."""
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "no id here"), (4, LONG), (5, "Ünïcode ça va x\x0by\r\nz\t\t"), (6, " \n \n"), (7, LONG)]
    d = make_docs(rows)
    from pyspark.sql import functions as F

    return d.withColumns({c: F.lit(1) for c in ("id", "t", "h", "fp", "_key", "_w", "score", "words", "lines", "uid", "a", "b", "n", "shard", "kind")})
