"""Near-duplicate classes by SimHash and a vantage-point tree.

A tree over the 64-bit fingerprints, grown from a sample of them, parts them
by their Hamming distance to vantage points into leaves, the shards; leaves
that turn out overfull are sampled again and subdivided. A fingerprint is
stored in its home leaf and queries every leaf behind it that the ball of
RADIUS bits around it reaches by the triangle inequality: at a node with
vantage point v and bound mu, inside if d - RADIUS <= mu and outside if
d + RADIUS > mu. A shard looks up what agrees with one of its fingerprints in
one of BANDS parts (RADIUS bits can't touch all of them) and keeps the pairs
that all 64 bits show to be within RADIUS. It joins them up at once, block by
block, and returns a star for each local class, never a list of pairs; classes
are joined up by spreading smallest labels.

Distances of unrelated fingerprints crowd around 32 bits, so a ball of 4 bits
crosses many bounds: visits grow by about 1.6 with each level of the tree.
Leaves are therefore large (LEAF) and searched through an index of their own.

Null texts and texts without words have fingerprint zero, null ids are never
a class id where another id is there, repeated rows share a class, other
columns are ignored (keep_one gives them back as they are), and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import few, fresh, run_dir, text_of, written

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a leaf aimed at, the least depth of the tree (leaves are tasks), sampled fingerprints at most, rounds of subdivision.
LEAF, MIN_DEPTH, SAMPLE, ROUNDS = 1 << 17, 5, 1 << 18, 3
#: Links of a fingerprint for which files are made; more of them make files larger.
LINKS = 8
#: Vantage points tried for a node.
TRIED = 24
#: Queries and candidates worked on at once.
QUERIES, CANDIDATES = 1 << 16, 1 << 20


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text over its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return majority(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes of a text's shingles."""
    on = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        on += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(on * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.encode(text_of(text), "utf-8").alias("t")).mapInArrow(work, f"id {kind}, fp long")


class Tree:
    """Vantage points with their bounds; a child is a node's number, or -1 - leaf."""

    def __init__(self):
        self.vantage: list[int] = []
        self.bound: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.root, self.leaves = -1, 1

    def grow(self, sample: np.ndarray, depth: int, leaf: int = 0, seed: int = 42) -> None:
        """Put a subtree of at most so many levels, fitted to the sample, in the place of a leaf."""
        rng = np.random.default_rng(seed + leaf)
        free = [leaf]

        def branch(some: np.ndarray, level: int) -> int:
            chosen = self.split(some, rng) if level else None
            if chosen is None:
                if free:
                    return -1 - free.pop()
                self.leaves += 1
                return -self.leaves
            v, mu = chosen
            node = len(self.vantage)
            self.vantage.append(v)
            self.bound.append(mu)
            self.inside.append(0)
            self.outside.append(0)
            near = np.bitwise_count(some ^ np.uint64(v)) <= mu
            self.inside[node] = branch(some[near], level - 1)
            self.outside[node] = branch(some[~near], level - 1)
            return node

        top = branch(sample, depth)
        if self.root == -1 - leaf:
            self.root = top
            return
        for side in (self.inside, self.outside):
            # the new nodes stand behind the one that led to the leaf
            for node, child in enumerate(side):
                if child == -1 - leaf and not self.below(top, node):
                    side[node] = top
                    return

    def below(self, top: int, node: int) -> bool:
        """Whether a node is in the subtree of another; subtrees are numbered in one run."""
        return top >= 0 and node >= top

    @staticmethod
    def split(some: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
        """The vantage point and bound that the fewest balls cross, of those that leave a third or more on either side."""
        if len(some) < 8:
            return None
        some = some if len(some) <= 4096 else rng.choice(some, 4096, replace=False)
        best = None
        for v in rng.choice(some, min(TRIED, len(some)), replace=False):
            have = np.bincount(np.bitwise_count(some ^ v), minlength=65 + RADIUS)
            upto = np.cumsum(have)
            for mu in range(64):
                share = upto[mu] / len(some)
                if 1 / 3 <= share <= 2 / 3:
                    crossed = upto[mu + RADIUS] - (upto[mu - RADIUS] if mu >= RADIUS else 0)
                    if best is None or crossed < best[0]:
                        best = (crossed, int(v), mu)
        return best and best[1:]

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The leaf that each fingerprint is stored in."""
        out = np.zeros(len(fps), np.int32)
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                near = np.bitwise_count(fps[at] ^ np.uint64(self.vantage[node])) <= self.bound[node]
                todo += [(self.inside[node], at[near]), (self.outside[node], at[~near])]
        return out

    def visits(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the fingerprints whose ball reaches it), leaf after leaf."""
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                yield -1 - node, at
            elif len(at):
                d = np.bitwise_count(fps[at] ^ np.uint64(self.vantage[node])).astype(np.int16)
                todo += [(self.inside[node], at[d - RADIUS <= self.bound[node]]), (self.outside[node], at[d + RADIUS > self.bound[node]])]


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    up = parent[x]
    while (up != x).any():
        x, up = up, parent[up]
    return x


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j, pair by pair; the smaller root stays."""
    while len(i):
        a, b = roots(parent, i), roots(parent, j)
        parent[i], parent[j] = a, b  # short ways from now on
        apart = a != b
        i, j = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


class Shard:
    """The sorted fingerprints of a leaf, their classes so far, and an index of each of RADIUS + 1 parts of their bits."""

    def __init__(self, stored: np.ndarray):
        self.stored, self.parent = stored, np.arange(len(stored))
        cuts = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
        self.bands = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            of = self.part(stored, lo, hi)
            self.bands.append((lo, hi, np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=1 << hi - lo))])))

    @staticmethod
    def part(fps: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((fps >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1)).astype(np.int64)

    def hits(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in `fps`, places of stored fingerprints) within RADIUS of each other, some at a time; a pair may come more than once."""
        for lo, hi, order, starts in self.bands:
            of = self.part(fps, lo, hi)
            first, n = starts[of], starts[of + 1] - starts[of]
            ends = np.cumsum(n)
            for at in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
                to = min(at + CANDIDATES, int(ends[-1]))
                q0, q1 = np.searchsorted(ends, [at, to - 1], side="right")
                some = n[q0 : q1 + 1].copy()
                some[-1] -= ends[q1] - to
                skipped = at - (ends[q0] - n[q0])
                some[0] -= skipped
                q = np.repeat(np.arange(q0, q1 + 1), some)
                begin = first[q0 : q1 + 1].copy()
                begin[0] += skipped
                r = order[np.repeat(begin - (np.cumsum(some) - some), some) + np.arange(to - at)]
                good = np.flatnonzero(np.bitwise_count(fps[q] ^ self.stored[r]) <= RADIUS)
                if len(good):
                    yield q[good], r[good]

    def link_stored(self) -> None:
        for at in range(0, len(self.stored), QUERIES):
            for q, r in self.hits(self.stored[at : at + QUERIES]):
                other = q + at != r
                unite(self.parent, q[other] + at, r[other])

    def link_guests(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(guest, a stored fingerprint) for each guest with a link; all that a guest links to become one class."""
        held = np.full(len(fps), -1, np.int64)
        for q, r in self.hits(fps):
            new = held[q] < 0
            held[q[new]] = r[new]
            unite(self.parent, held[q], r)
        linked = np.flatnonzero(held >= 0)
        return fps[linked], self.stored[held[linked]]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, the smallest of its class) of all but the smallest ones."""
        root = roots(self.parent, np.arange(len(self.stored)))
        odd = np.flatnonzero(root != np.arange(len(root)))
        return self.stored[odd], self.stored[root[odd]]


def grown(distinct: DataFrame, n: int) -> Tree:
    """The tree for the written table `distinct` of n fingerprints; SAMPLE of them at most reach the driver at once."""
    tree = Tree()

    def sampled(rows: DataFrame, size: int, of: int, seed: int) -> list:
        u = F.shiftrightunsigned(F.xxhash64("fp", F.lit(seed)), 11) / float(1 << 53)
        return sorted(tuple(r) for r in rows.where(u < size / max(of, 1)).collect())

    depth = max(MIN_DEPTH, (-(-n // LEAF) - 1).bit_length())
    tree.grow(np.array([r[0] for r in sampled(distinct.select("fp"), min(SAMPLE // 2, 256 << depth), n, 42)], np.int64).view(np.uint64), depth)
    for again in range(ROUNDS if n > 2 * LEAF else 0):

        def leaf(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                fps = b.column("fp").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(tree.home(fps.view(np.uint64)))], ["fp", "leaf"])

        placed = distinct.select("fp").mapInArrow(leaf, "fp long, leaf int")
        # a row for each overfull leaf, of which there are at most n / (2 * LEAF)
        over = {r[0]: r[1] for r in placed.groupBy("leaf").agg(F.count("*").alias("k")).where(F.col("k") > 2 * LEAF).collect()}
        had = tree.leaves
        some: dict[int, list[int]] = {}
        for fp, k in sampled(placed.where(F.col("leaf").isin(list(over))), SAMPLE // 2, sum(over.values()), 43 + again) if over else []:
            some.setdefault(k, []).append(fp)
        for k, fps in sorted(some.items()):
            tree.grow(np.array(fps, np.int64).view(np.uint64), (-(-over[k] // LEAF) - 1).bit_length(), k)
        if tree.leaves == had:
            break
    return tree


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): fingerprints of one class of some shard; enough to connect all within RADIUS."""
    tree = grown(distinct, n)

    def visit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = b.column("fp").to_numpy()
            u = fps.view(np.uint64)
            home = tree.home(u)
            for leaf, at in tree.visits(u):
                # the fingerprint with the smaller leaf's number finds the pair
                at = at[home[at] <= leaf]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(fps[at]), pa.array(home[at] < leaf)], ["shard", "fp", "guest"])

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        at, stored, shard = None, [], None
        for b in batches:
            number, fps, guest = b.column("shard").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("guest").to_numpy(zero_copy_only=False)
            # runs of stored ones, then of guests, of each shard
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (guest[1:] != guest[:-1])) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if number[lo] != at:
                    if at is not None:
                        yield rows(*(shard or finished(stored)).stars())
                    at, stored, shard = number[lo], [], None
                if not guest[lo]:
                    stored.append(fps[lo:hi])
                    continue
                shard = shard or finished(stored)
                for some in range(lo, hi, QUERIES):
                    yield rows(*shard.link_guests(fps[some : min(hi, some + QUERIES)]))
        if at is not None:
            yield rows(*(shard or finished(stored)).stars())

    def finished(stored: list[np.ndarray]) -> Shard:
        shard = Shard(np.sort(np.concatenate(stored)) if stored else np.zeros(0, np.uint64))
        shard.link_stored()
        return shard

    visits = distinct.select("fp").mapInArrow(visit, "shard int, fp long, guest boolean")
    return visits.repartition("shard").sortWithinPartitions("shard", "guest").mapInArrow(link, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root) of every node of the written table `edges` (a, b): labels spread to neighbours and jump to their label's label until none changes."""
    spark = edges.sparkSession
    both = written(few(edges.select("a", "b").union(edges.select("b", "a")), 2 * edges.count()), run_dir(spark, f"{name}-edges"))
    n = both.count()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    labels = written(few(labels, n), run_dir(spark, f"{name}-labels"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        stepped = met.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "root")
        stepped = written(few(stepped, n), run_dir(spark, f"{name}-labels"))
        labels = stepped.select("node", F.col("new").alias("root"))
        if stepped.where("new <> root").isEmpty():
            return labels


def linked(fps: DataFrame) -> DataFrame:
    """fp and component_id (the smallest id of the class) of every distinct fingerprint of the written rows (id, fp)."""
    spark = fps.sparkSession
    distinct = written(few(fps.groupBy("fp").agg(F.min("id").alias("first")), fps.count()), run_dir(spark, "simhash-distinct"))
    n = distinct.count()
    edges = written(few(links(distinct, n), LINKS * n), run_dir(spark, "simhash-links"))
    roots = distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(few(roots.join(smallest, "root").select("fp", "component_id"), n), run_dir(spark, "simhash-classes"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id of the class) of every row."""
    fps = written(fingerprints(docs, id_col, text, words), run_dir(docs.sparkSession, "simhash-fingerprints"))
    return fps.join(linked(fps), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with the smallest id of each class, one row of an id; rows without an id stay only where no row of their class has one.

    `classes` has the id and component_id of every row; by default those of near_duplicates.
    """
    spark = docs.sparkSession
    classes = near_duplicates(docs, id_col, text) if classes is None else classes
    name, count = fresh(docs, "kept_id"), fresh(docs, "kept_n")
    kept = classes.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias(count))
    kept = written(few(kept, docs.count()), run_dir(spark, "simhash-kept"))
    # the ids have no bound on their size, so they are never broadcast, however few they are; nor hashed, as a task that takes
    # several partitions for one file would hold the tables of them all until it ends
    of = lambda rows: docs.join(rows.select(name).hint("merge"), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    again = kept.where((F.col(count) > 1) & F.col(name).isNotNull())
    once = of(kept.where((F.col(count) == 1) | F.col(name).isNull()))
    return once if again.isEmpty() else once.unionByName(of(again).dropDuplicates([id_col]))
