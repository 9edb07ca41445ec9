"""Line-first cleaning with built-in functions only.

Each line is tested by itself for punctuation, navigation and boilerplate;
failing lines go, and a document that loses too much of its words, or keeps
too few, is rejected. Beside that stand the counts of the whole text: words,
symbols, repeated lines and words in repeated three-word windows.

Null texts are empty ones and fail, null ids and repeated rows stay as they
are, other columns are ignored, and an empty table gives an empty result.
Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WORD, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document may lose this share of its words' characters to the line rules.
MAX_LOST = 0.5

#: Line rules, in a syntax that Java and RE2 share. Menus and tables: three separators or more, or a bare menu item.
NAVIGATION = r"([|»›•·][^|»›•·]*){3}"
MENU = r"^[\x20\x09-\x0D]*(?i:home|menu|login|log in|sign in|sign up|search|next|previous|contact us|about us|site map|sitemap)[\x20\x09-\x0D]*\z"
BOILERPLATE = r"(?i)(all rights reserved|copyright (\(c\)|©|[0-9])|terms (of|and) (use|service|conditions)|privacy policy|cookies? (policy|settings)|accept (all )?cookies|subscribe to our|click here|enable javascript|javascript is (disabled|required)|lorem ipsum|powered by|share (this )?on)"
#: Each alternative of BOILERPLATE has one of these.
BOILERPLATE_HAS = ("rights reserved", "copyright", "terms ", "privacy policy", "cookie", "subscribe to", "click here", "javascript", "lorem ipsum", "powered by", "share ")
#: The end of a word that closes in two symbols or more, or in repeated exclamation or question marks.
NOISY = r"([#*$%&|<>]{2,}|[!?]{2,})[.,;:]?([\x20\x09-\x0D]|\z)"
#: What closes a line of prose.
CLOSED = r"[.!?…:;,\"”»’')\]。！？][\x20\x09-\x0D]*\z"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: hashes of the windows, sorted with their places, so that equal ones meet."""
    n = F.size(words)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            again = F.filter(s, lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.get(F.transform(F.array(placed), repeats), F.lit(0)))

    # bound as a variable, so that the windows are made once
    return F.get(F.transform(F.array(windows), covered), F.lit(0))


def line_fails(line: Column, may: Column) -> Column:
    """Whether a line breaks one of the rules; `may` says which rules the document has cause for. A line without a word passes."""
    n = F.regexp_count(line, F.lit(WORD))
    open_ = (F.right(line, F.lit(1)) != ".") & ~line.rlike(CLOSED) & n.between(1, 2)
    # conjunctions stop at their first false half, so costly patterns meet few lines
    return (
        (may["navigation"] & line.rlike(NAVIGATION))
        | (may["boilerplate"] & line.rlike(BOILERPLATE))
        | (may["noise"] & (F.regexp_count(line, F.lit(NOISY)) * 3 > n))
        | open_
        | ((F.length(line) < 40) & line.rlike(MENU))
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts, base_failed, lost (share of word characters on failing lines), cleaned (the lines that pass) and kept."""
    t, has_word = F.col("t"), lambda x: x.rlike(WORD)
    low = F.lower(t)
    some = lambda text, parts: F.expr("false") if not parts else text.contains(parts[0]) | some(text, parts[1:])
    may = F.struct(some(t, "|»›•·").alias("navigation"), some(low, BOILERPLATE_HAS).alias("boilerplate"), t.rlike(r"[#*$%&|<>]{2}|[!?]{2}").alias("noise"))
    rows = docs.select(F.col(id_col), text_of(text).alias("t")).withColumns({"words": words_of(t), "lines": F.split("t", "\n", -1), "may": may})
    symbols = F.length(t) - F.length(F.translate("t", SYMBOLS, ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.when(t.rlike("[#*$%&|<>]"), symbols).otherwise(0).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")).cast("long"),
            "worded": F.filter("lines", has_word),
            "cleaned": F.array_join(F.filter("lines", lambda x: ~line_fails(x, F.col("may"))), "\n"),
        }
    )
    whole = F.col("cleaned") == t
    good_chars = F.when(whole, F.col("word_chars")).otherwise(F.length(F.regexp_replace("cleaned", r"[\x20\x09-\x0D]+", "")))
    good_words = F.when(whole, F.col("n_words")).otherwise(F.regexp_count("cleaned", F.lit(WORD)))
    rows = rows.withColumn("n_dup_lines", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"))
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "lost": F.when(F.col("word_chars") == 0, F.lit(1.0)).otherwise(1 - good_chars / F.col("word_chars")),
        }
    )
    kept = ~F.col("base_failed") & (F.col("lost") <= MAX_LOST) & (good_words >= MIN_WORDS)
    return rows.withColumn("kept", kept).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost", "cleaned")
