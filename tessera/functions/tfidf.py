"""Word and character n-gram TF-IDF as relational aggregates.

Weights are (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each document scaled
to length one. Terms below min_df go; of the others the most frequent stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import unicode

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*"


def word_grams(text: Column) -> Column:
    """Words and pairs of neighbours, lower-cased."""
    def of(words: Column) -> Column:
        pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
        return F.concat(words, pairs)

    # bound as a variable, so that the words are found once
    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))), of), F.lit(0))


def char_grams(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Character n-grams inside words, each word padded by a space on both sides; a word no longer than n gives itself once."""
    words = F.filter(F.split(F.lower(text), unicode(r"\s+")), lambda w: F.length(w) > 0)

    def grams(n: int) -> Column:
        def of(w: Column) -> Column:
            p = F.concat(F.lit(" "), w, F.lit(" "))
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))

        return of

    # a padded word shorter than n is counted for the least such n only
    parts = [F.flatten(F.transform(words if n == shortest else F.filter(words, lambda w: F.length(w) + 2 >= n), grams(n))) for n in range(shortest, longest + 1)]
    return F.concat(*parts)


def tallied(grams: Column) -> Column:
    """Each gram of an array with how often it is in it: sorted, runs are told by where they begin."""
    bound = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))  # noqa: E731 - a variable, so that it is found once

    def of(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(words)) - i).cast("long").alias("tf"))))

    return bound(F.sort_array(grams), of)


def counted(docs: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """(id, term, tf) of every document.

    A document is counted where its row lies. Only rows that share their id
    with others are put together by a shuffle of their terms; whether there
    are any is asked at once, of the ids alone.
    """
    shared = docs.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_shared"))
    each = lambda rows: rows.select(F.col(id_col), F.inline(tallied(grams)))
    if shared.isEmpty():
        return each(docs)
    same = docs[id_col].eqNullSafe(shared["_shared"])
    together = each(docs.join(shared, same, "left_semi")).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))
    return each(docs.join(shared, same, "left_anti")).unionByName(together)


def fit_terms(counts: DataFrame, n: DataFrame, min_df: int = 3, max_terms: int = 20_000) -> DataFrame:
    """(term, idf) of at most `max_terms` terms, from (id, term, tf) and a row with the number of documents, n."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_terms)
    return terms.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighed(counts: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, weight and the other columns of `terms`), each document's weights scaled to length one; `terms` has as many rows as fit_terms was asked for."""
    raw = counts.join(F.broadcast(terms), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.withColumn("weight", F.col("w") / length).drop("tf", "idf", "w")


def tfidf(docs: DataFrame, id_col: str, grams: Column, min_df: int = 3, max_terms: int = 20_000) -> DataFrame:
    """(id, term, weight) of every document."""
    counts = counted(docs, id_col, grams)
    return weighed(counts, fit_terms(counts, docs.agg(F.count("*").alias("n")), min_df, max_terms), id_col).select(id_col, "term", "weight")
