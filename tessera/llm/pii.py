"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base matches of four kinds are the seeds. The one or two words to the left of
everything that looks like an identifier are its lexical patterns. Patterns
and instances make a bipartite graph over the whole corpus; for ROUNDS rounds
patterns are scored by the share of their instances that are known, and
instances by the patterns they stand in; what is found beyond doubt counts as
a seed in the next round. Patterns of high confidence, seen
with several seeds, then mark what else stands in them and has the kind's
rough shape. Only built-in DataFrame functions are used.

Null texts are empty ones, null ids and repeated rows stay as they are, other
columns are ignored (masked gives them back as they are), and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import few, fresh, run_dir, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no run of characters is read twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What looks like an identifier: groups of digits, or a word with a digit or an at sign.
LOOSE = r"\+?\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++|(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+(?<=[A-Za-z0-9])"
#: Rounds of scoring, distinct seeds that a pattern needs, its least confidence, and the score from which a found instance is a seed of the next round.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, SURE = 3, 3, 0.6, 0.9
SPAN = "struct<kind:int,s:int,e:int>"


def last_words(text: Column) -> Column:
    """The last two words, or the last, of a text."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^\s*(\S+(?:\s+\S+)?)", 1))


def located(t: Column, pattern: str, context: bool = False) -> Column:
    """(s, e, m, left) of every match, left to right: code points before it are those of the segments and matches so far.

    `left`, if asked for, has the words before a match; in a list, where only
    signs stand between two matches, those before its first.
    """
    whole = F.arrays_zip(F.split(t, pattern, -1).alias("seg"), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("m"))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("left"), F.array().cast("array<struct<s:int,e:int,m:string,left:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["seg"])
        end = at + F.length(x["m"])
        left = F.when(x["seg"].rlike(r"\p{L}"), last_words(x["seg"])).otherwise(acc["left"]) if context else F.lit("")
        found = F.struct(at.alias("s"), end.alias("e"), x["m"].alias("m"), left.alias("left"))
        return F.struct(F.coalesce(end, at).alias("pos"), left.alias("left"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out"))

    return F.aggregate(whole, start, step, lambda acc: acc["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, i, F.lit(1))) - 48
        return total + F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # a part beyond three digits is over 255 unless zeros lead it
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, F.lit("^0+"), F.lit(""))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(t: Column) -> Column:
    """Valid matches of all kinds as (kind's number, s, e), by kind, then start."""
    may = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.rlike(r"\+[0-9]")}
    none = F.array().cast(f"array<{SPAN}>")

    def of(k: int, kind: str) -> Column:
        good = F.filter(located(t, PATTERNS[kind]), lambda x: valid(kind, x["m"]))
        return F.when(may[kind], F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).otherwise(none)

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def rough(kind: Column, m: Column) -> Column:
    """Whether an unseen identifier has the rough shape of a kind."""
    n = F.length(digits(m))
    return (
        F.when(kind == 0, m.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == 1, m.rlike(r"^[0-9]+(\.[0-9]+){2,}$"))
        .when(kind == 2, n.between(13, 19) & m.rlike(r"^[0-9\x20-]+$"))
        .otherwise(n.between(7, 15) & m.rlike(r"^[+(0-9][0-9().\x20-]+$"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scored_patterns(occurrences: DataFrame) -> DataFrame:
    """(pattern, kind) of high confidence, from written occurrences (pattern, instance, kind or null)."""
    spark = occurrences.sparkSession
    # instances of a pattern, each once; a seed's kind goes with its instance wherever that stands
    n = occurrences.count()
    edges = written(few(occurrences.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), n), run_dir(spark, "pii-edges"))
    seeds = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    # only patterns that some seed stands in can ever gain confidence from it
    score = seeds
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    for _ in range(ROUNDS):
        known = edges.select("pattern", "instance").join(score, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.when(F.col("score") >= SURE, 1)).alias("seeds"))
        patterns = known.where(F.col("seeds") >= MIN_SEEDS).join(sizes, "pattern").select("pattern", "kind", "seeds", (F.col("mass") / F.col("n")).alias("confidence"))
        patterns = written(few(patterns, n), run_dir(spark, "pii-patterns"))
        good = patterns.where(F.col("confidence") >= MIN_CONFIDENCE)
        # an instance is as sure as its patterns together: one minus the product of their doubts
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        grown = edges.select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        fresh = grown.join(seeds.select("instance"), "instance", "left_anti").where("score < 1")
        score = seeds.select("instance", "kind", "score").unionByName(fresh.select("instance", "kind", "score"))
        score = written(few(score, n), run_dir(spark, "pii-instances"))
    return patterns.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h (the text's hash), base (spans) and spans (all, sorted) of every row; spans are (kind's number, s, e) in code points."""
    spark = docs.sparkSession
    t = F.col("t")
    left = F.lower(F.rtrim(F.translate(F.col("x.left"), "\n\t\r", "   ")))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("h"), base_spans(t).alias("base"), F.when(t.rlike("[0-9@]"), located(t, LOOSE, True)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,left:string>>")).alias("loose"))
    table = written(rows, run_dir(spark, "pii-spans"))
    at = table.where(F.size("loose") > 0).select("id", "h", "base", F.explode("loose").alias("x"))
    seed = F.get(F.filter("base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s"))), F.lit(0))["kind"]
    at = at.select("id", "h", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("m"), seed.alias("kind"), F.regexp_extract(left, r"(\S+)$", 1).alias("one"), F.regexp_extract(left, r"(\S+\s+\S+)$", 1).alias("two"))
    at = at.select("id", "h", "s", "e", "m", "kind", F.lower(F.regexp_replace("m", r"[\x20().-]", "")).alias("instance"), F.explode(F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), F.regexp_replace("two", r"\s+", " ")))).alias("pattern"))
    at = written(at.where(F.length("pattern") > 3), run_dir(spark, "pii-occurrences"))
    patterns = scored_patterns(at.select("pattern", "instance", "kind"))
    new = at.where("kind IS NULL").drop("kind").join(patterns, "pattern").where(rough(F.col("kind"), F.col("m")))
    # one kind for each place, the first listed; a place stands once though two patterns found it
    new = new.groupBy("id", "h", "s").agg(F.min(F.struct("kind", "s", "e")).alias("span")).groupBy("id", "h").agg(F.collect_list("span").alias("more"))
    both = table.select("id", "h", "base").join(new.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "more"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left")
    return both.select(F.col("id").alias(id_col), table["h"], "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; a span that overlaps an earlier one is left to it. Null texts stay null."""
    found = find(docs, id_col, text)
    key, h, held = (fresh(docs, f"pii_{x}") for x in ("id", "hash", "spans"))
    spans = found.where(F.size("spans") > 0).groupBy(F.col(id_col).alias(key), F.col("h").alias(h)).agg(F.first("spans").alias(held))
    rows = docs.join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_of(text)) == F.col(h)), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_place = F.array_sort(F.transform(held, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(F.substring(F.col(text), acc["pos"] + 1, x["s"] - acc["pos"]), F.get(names, x["kind"]))
        return F.when(x["s"] < acc["pos"], acc).otherwise(F.struct(x["e"].alias("pos"), F.concat(acc["out"], piece).alias("out")))

    done = F.aggregate(by_place, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["pos"] + 1, F.length(text))))
    return rows.withColumn(text, F.when(F.col(h).isNull(), F.col(text)).otherwise(done)).select(*docs.columns)
