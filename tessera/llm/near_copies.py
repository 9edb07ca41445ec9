"""Near-copy classes by SimHash, made whole and exact by Jaccard similarity of word shingles.

Texts of equal shingle sets are one from the start. The others go through the
vantage-point tree of operator 3 by the fingerprints of their shingles; what
it puts together is verified with the class's text of the smallest number on
the shingle sets themselves. At a similarity of 0.8 fingerprints differ in
some 10 of 64 bits, so the tree alone would miss links; bands of min-hashes
give the rest, and look only at texts that SimHash hasn't put into one class.
A signature of BANDS * ROWS min-hashes, a byte each, stands for a set; a band
is ROWS of them in one number. Texts meet where they share a band, which a
pair of similarity 0.8 fails to do with probability (1 - 0.8 ** ROWS) **
BANDS, about 8e-6, and a closer one less often. What meets is compared in two
rounds. First every member of a band's group with the group's centre, the
member of the smallest number, so that near copies meet the same centre in
most of their bands. Then, in groups (SimHash classes too) that still hold
several classes, members of different classes with each other, block by block
where a group is large; a block gives a link only where it joins two classes.
Pairs whose signatures agree in less than LIKELY of their bytes, five
deviations below the similarity, are passed by; the others are verified on
the shingle sets.

Texts without words are one class, a text below WORDS words is one shingle,
null ids are never a class id where another id is there, other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WIDE_ROWS, few, release, run_dir, text_of, written
from tessera.llm.simhash import components, linked, majority

#: Words of a shingle, and the least similarity of linked texts.
WORDS, SIMILARITY = 5, 0.8
#: Bands of a signature, min-hashes of a band (a byte each, so that a band is a long), shingles hashed at once.
BANDS, ROWS, BLOCK = 64, 8, 512
#: Share of equal bytes that signatures of alike sets have all but surely.
LIKELY = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
#: Members of a group's block; rows of sets or signatures handed to Python at once.
MEMBERS, BATCH = 512, 256

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the shingles of a UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, shingles), np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text."""
    return np.unique(shingle_hashes(text))


def digest(s: np.ndarray) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    """The bands of a set as signed longs; none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    short = (s >> np.uint64(32)).astype(np.uint32)
    low = np.min([((short[at : at + BLOCK] ^ _XOR) * _TIMES).min(1) for at in range(0, len(s), BLOCK)], axis=0)
    return (low >> np.uint32(12)).astype(np.uint8).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is run inside, where a row can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text hash, key (digest of the shingle set), fingerprint and bands of every row."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        for b in batches:
            keys, fps, bands = [], np.zeros(b.num_rows, np.uint64), []
            for k, t in enumerate(b.column("t")):
                h = shingle_hashes(t.as_py())
                fps[k], s = majority(h), np.unique(h)
                keys.append(digest(s))
                bands.append(signature(s))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(keys, pa.binary()), pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "key", "fp", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text)).alias("th"), F.encode(text_of(text), "utf-8").alias("t"))
    return rows.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, th long, key binary, fp long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """uid and shingle set of the wanted (th, key, uid); more than once at most where Spark splits a text's copies."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for b in batches:
            uids, sets = [], []
            for u, k, t in zip(b.column("uid").to_pylist(), b.column("key").to_pylist(), b.column("t"), strict=True):
                if u not in seen:
                    s = shingle_set(t.as_py())
                    if digest(s) == k:
                        seen.add(u)
                        uids.append(u)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sets, pa.binary())], ["uid", "s"])

    texts = docs.select(F.xxhash64(text_of(text)).alias("th"), F.encode(text_of(text), "utf-8").alias("t"))
    return texts.join(wanted.hint("shuffle_hash"), "th").select("uid", "key", "t").mapInArrow(work, "uid long, s binary")


def filtered(pairs: DataFrame, of: DataFrame, value: str, good) -> DataFrame:
    """The pairs (a, b) for which good(values of a, values of b) holds; `of` has uid and the value."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(good(batch.column("x"), batch.column("y")), pa.bool_()))

    left, right = (of.select(F.col("uid").alias(n), F.col(value).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are alike."""
    return filtered(pairs, sets, "s", lambda x, y: [alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(x, y, strict=True)])


def matrix(column) -> np.ndarray:
    """The bytes of a list column of signatures, a row for each."""
    return column.flatten().to_numpy().view(np.uint8).reshape(len(column), BANDS * ROWS)


def likely(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose signatures are like those of alike sets."""
    return filtered(pairs, distinct, "bands", lambda x, y: (matrix(x) == matrix(y)).mean(1) >= LIKELY)


def across(members: DataFrame, distinct: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a < b) between different classes within the groups of `members` (h, uid, root, n).

    A block compares the signatures of its members, verifies what is likely
    on their sets, the likeliest first, and gives a link only where it joins
    two classes: fewer links than members, however many pairs are looked at.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / MEMBERS)).cast("int")
    mine = F.pmod(F.xxhash64("uid"), F.col("m")).cast("int")
    rows = members.withColumn("m", blocks).withColumn("c", mine)
    # each block meets each block: a member goes to as many places as its group has blocks
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("h", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "uid", "root")
    rows = rows.join(distinct.select("uid", "bands"), "uid").join(sets, "uid")

    def joined(held: list, i: int, j: int) -> list[tuple[int, int]]:
        c, uid, root, sig = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        own = [np.frombuffer(x, np.uint64) for part in held for x in part[4]]
        label, out = np.unique(root, return_inverse=True)[1], []
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        for at in left.tolist():
            there = right[(label[right] != label[at]) & (uid[right] > uid[at] if i == j else True)]
            share = (sig[there] == sig[at]).mean(1)
            for k in there[np.argsort(-share, kind="stable")][: int((share >= LIKELY).sum())].tolist():
                if label[k] != label[at] and alike(own[at], own[k]):
                    label[label == label[k]] = label[at]
                    out.append((int(min(uid[at], uid[k])), int(max(uid[at], uid[k]))))
        return out

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = lambda links: pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], ["a", "b"])
        at, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("h", "i", "j")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            cols = [batch.column(x).to_numpy() for x in ("c", "uid", "root")] + [matrix(batch.column("bands")), batch.column("s").to_pylist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at is not None and keys[lo] != at:
                    yield made(joined(held, *at[1:]))
                    held = []
                at = keys[lo]
                held.append([x[lo:hi] for x in cols])
        if held:
            yield made(joined(held, *at[1:]))

    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(work, "a long, b long").distinct()


def found(distinct: DataFrame) -> DataFrame:
    """uid and center (the smallest uid) of the SimHash classes of the sets that have shingles."""
    some = distinct.where(F.size("bands") > 0).select("uid", "fp")
    return some.join(linked(some.withColumnRenamed("uid", "id")), "fp").select("uid", F.col("component_id").alias("center"))


def banded(distinct: DataFrame) -> DataFrame:
    """h, uid, center (the smallest uid) and n of the groups that share a band of min-hashes."""
    each = distinct.select("uid", F.posexplode("bands").alias("k", "v")).select("uid", F.xxhash64("k", "v").alias("h"))
    return each.join(each.groupBy("h").agg(F.min("uid").alias("center"), F.count("*").alias("n")).where("n > 1"), "h")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and component_id (the smallest id of the class) of every row."""
    spark = docs.sparkSession
    keep = lambda df, name: written(df, run_dir(spark, f"near-{name}"))
    rows = keep(keyed(docs, id_col, text), "rows")
    # the bands follow from the key; a number for each key is written once
    distinct = rows.groupBy("key").agg(F.min("id").alias("first"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = keep(few(distinct, rows.count(), WIDE_ROWS).withColumn("uid", F.monotonically_increasing_id()), "distinct")

    n = distinct.count()

    def texts(wanted: DataFrame) -> DataFrame:
        return sets_of(docs, distinct.select("th", "key", "uid").join(wanted, "uid", "left_semi"), text)

    def alike_of(pairs: DataFrame, most: int) -> DataFrame:
        with batches_of(spark, BATCH):
            good = keep(few(likely(pairs, distinct), most), "likely")
            most = good.count()
            sets = keep(few(texts(good.select(F.col("a").alias("uid")).union(good.select("b")).distinct()), min(2 * most, n), WIDE_ROWS), "sets")
            return keep(few(verified(good, sets).distinct(), most), "edges")

    def rooted(edges: DataFrame) -> DataFrame:
        return components(edges, "near").withColumnRenamed("node", "uid")

    near = keep(few(found(distinct), n), "simhash")
    edges = alike_of(near.where("uid <> center").select(F.col("center").alias("a"), F.col("uid").alias("b")), n)
    roots = rooted(edges)

    # what SimHash left apart and a band holds together
    members = keep(few(banded(distinct), BANDS * n), "members")
    held = members.count()
    of = lambda name: roots.select(F.col("uid").alias(name), F.col("root").alias(f"{name}_root"))
    stars = members.where("uid <> center").select(F.col("center").alias("a"), F.col("uid").alias("b")).distinct()
    stars = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    edges = keep(few(edges.unionByName(alike_of(keep(few(stars, held), "stars"), held)), n), "edges")
    roots = rooted(edges)

    # groups whose members the stars left in several classes, beyond pairs, which the stars have settled
    sized = near.join(near.groupBy("center").agg(F.count("*").alias("n")).where("n > 2"), "center").select(F.xxhash64("center", F.lit("simhash")).alias("h"), "uid", "n")
    groups = members.where("n > 2").select("h", "uid", "n").unionByName(sized)
    placed = groups.join(roots, "uid", "left").select("h", "uid", "n", F.coalesce("root", "uid").alias("root"))
    placed = keep(few(placed, held + n), "placed")
    mixed = placed.groupBy("h").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("h")
    left = keep(few(placed.join(mixed, "h", "left_semi"), held + n), "mixed")
    if not left.isEmpty():
        with batches_of(spark, BATCH):
            sets = keep(few(texts(left.select("uid").distinct()).dropDuplicates(["uid"]), min(left.count(), n), WIDE_ROWS), "sets")
            edges = keep(few(edges.unionByName(across(left, distinct, sets)).distinct(), edges.count() + left.count()), "edges")
        roots = rooted(edges)

    whole = distinct.select("key", "uid", "first").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    smallest = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    of = keep(few(whole.join(smallest, "root").select("key", "component_id"), n), "classes")
    return rows.select("id", "key").join(of, "key").select(F.col("id").alias(id_col), "component_id")
