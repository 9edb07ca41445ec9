"""Text functions of Spark columns that need places of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


def unicode(pattern: str) -> str:
    """The pattern with word characters, boundaries and case by Unicode, as in Python."""
    return f"(?uU){pattern}"


def match_spans(t: Column, pattern: str) -> Column:
    """(s, e, m) of all matches of a never-empty pattern, from the lengths of the segments between them and of the matches so far."""
    whole = F.arrays_zip(F.split(t, pattern, -1).alias("seg"), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("m"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["seg"])
        end = at + F.length(x["m"])
        found = F.struct(at.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(F.coalesce(end, at).alias("pos"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out"))

    return F.aggregate(whole, start, step, lambda acc: acc["out"])


def count_matches(t: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(t, F.lit(pattern))


def found_from(t: Column, lo: Column, hi: Column, pattern: str) -> Column:
    """Whether the pattern matches in [lo, hi); what stands before lo is seen by look-behinds and word boundaries, what follows hi isn't."""
    rest = F.substring(t, lo, hi - lo + 1)  # one character earlier, which the match may not begin with
    return F.when(lo > 0, rest.rlike(f"(?s:(?<=.))(?:{pattern})")).otherwise(F.substring(t, F.lit(1), hi).rlike(pattern))


def strip(t: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)\s+\z", "")
