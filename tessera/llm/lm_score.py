"""N-gram language model on an Elias-Fano trie.

Unigrams are add-one estimates over all training tokens. Above them stand
bigrams and trigrams seen MIN_COUNT times or more (by default all of them),
by interpolated absolute discounting: what a context's kept followers leave
goes, as its back-off weight, to the next lower order, so probabilities sum
to one. A trigram is counted where both its bigrams are kept.

Texts are split once, into a written table of slices: the hashes of a slice's
distinct words, and its words as places among these. N-grams are
counted within a task, packed (sorted, byte by byte, compressed) and sent to
the segment of the trie that they belong to, which merges them and writes its
file: no row is made for an n-gram. Lookups go through the distinct n-grams
of some documents in order, so a task opens the segments that these need and
walks each from front to back.

Null texts have only their end token, null ids count as the empty text in the
hold-out, repeated rows are scored (and trained on) each, other columns are
ignored, and an empty table gives an empty result. Words are told apart by
64-bit hashes; a context's followers, at most as many as there are words, are
merged in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import by_bytes, run_dir, text_of, written
from tessera.llm.eftrie import Level, Vocabulary, groups, restored

MIN_COUNT, DISCOUNT = 1, 0.75
#: Entries of a segment aimed at, bytes of text for a segment of the vocabulary, n-grams counted before a task passes them on.
SEGMENT, WORD_BYTES, MAX_HELD = 2_000_000, 64 << 20, 2_000_000
#: Bytes of text, and words, worked on at once: mostly a whole slice, as each run of documents asks every segment.
TEXT, WORDS = 8 << 20, 2_000_000
#: No word: the end of a text. Words have no line feeds.
END = b"\n"
#: Stands for all followers that aren't kept.
OTHER = (1 << 31) - 1


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def split(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words of an Arrow array of texts, each text's words and its end as places among them, and where each text ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    place = words.indices.to_numpy()
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    # white space at either end leaves an empty word there
    empty = known.index(b"") if b"" in known else -1
    real = place != empty
    upto = np.concatenate([[0], np.cumsum(real)])[ends[1:]] + np.arange(1, len(ends))
    out = np.full(int(upto[-1]) if len(upto) else 0, len(known), np.int32)
    inside = np.ones(len(out), bool)
    inside[upto - 1] = False
    out[inside] = place[real]
    hashes = word_hashes([*known, END])
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return hashes[order], place[out], upto


def packed(columns: list[np.ndarray], ordered: bool = True) -> bytes:
    """Non-negative integer columns, the first of them sorted if `ordered`, byte by byte and compressed."""
    import pyarrow as pa

    n = len(columns[0])
    parts = []
    for i, c in enumerate(columns):
        v = c.astype(np.uint64)
        if ordered and not i and n:
            v[1:] -= v[:-1].copy()
        deep = (int(v.max()).bit_length() + 7) // 8 if n else 0
        parts.append(bytes([deep]) + np.ascontiguousarray(v.view(np.uint8).reshape(n, 8)[:, :deep].T).tobytes())
    raw = b"".join(parts)
    return n.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, columns: int, ordered: bool = True) -> list[np.ndarray]:
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[16:], int.from_bytes(blob[8:16], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for i in range(columns):
        deep = raw[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :deep] = np.frombuffer(raw, np.uint8, deep * n, at + 1).reshape(deep, n).T
        v = wide.reshape(-1).view(np.int64)
        out.append(np.cumsum(v) if ordered and not i else v)
        at += 1 + deep * n
    return out


def sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of non-negative pairs, and where each group of equal ones begins in it."""
    low, high, short = (int(x.max()).bit_length() if len(x) else 0 for x in (b, a, np.array([len(a)])))
    if low + high + short <= 63:  # with its place behind it, a plain sort of numbers tells the order too
        keys = ((a.astype(np.int64) << low | b) << short) | np.arange(len(a))
        keys.sort()
        order = keys & ((1 << short) - 1)
        return order, groups(keys >> short)
    if low + high <= 63:
        keys = a.astype(np.int64) << low | b
        order = np.argsort(keys)
        return order, groups(keys[order])
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    return order, np.flatnonzero(np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])) if len(a) else np.zeros(0, np.int64)


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (a, b) and the sums of their counts, from parts (a, b, counts); counts may be None for ones in all parts."""
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    counts = None if parts[0][2] is None else np.concatenate([p[2] for p in parts])
    low, high = (int(x.max()).bit_length() if len(x) else 0 for x in (b, a))
    if low + high <= 63:  # one number for a pair sorts faster
        keys = a.astype(np.int64) << low | b
        if counts is None:
            keys.sort()
        else:
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
        first = groups(keys)
        a, b = keys[first] >> low, keys[first] & ((1 << low) - 1)
        n = len(keys)
    else:
        order, first = sorted_pairs(a, b)
        counts, n = None if counts is None else counts[order], len(a)
        a, b = a[order[first]].astype(np.int64), b[order[first]].astype(np.int64)
    return a, b, np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


class Held:
    """Pairs of numbers, counted and passed on as rows (segment, blob) when there are many."""

    def __init__(self, width: int):
        self.width, self.parts, self.n = width, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator:
        self.parts.append((a, b, None))
        self.n += len(a)
        if self.n > MAX_HELD:
            yield from self.rows()

    def rows(self) -> Iterator:
        import pyarrow as pa

        if self.n:
            a, b, c = merged(self.parts)
            self.parts, self.n = [], 0
            seg = a // self.width
            cuts = [*groups(seg).tolist(), len(a)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            for at in range(0, len(spans), 64):  # a few rows at a time
                some = spans[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([int(seg[lo]) for lo, _ in some], pa.int32()), pa.array([packed([a[lo:hi], b[lo:hi], c[lo:hi]]) for lo, hi in some], pa.binary())], ["seg", "blob"])


def by_segment(batches: Iterator, columns: int) -> Iterator[tuple[int, list]]:
    """The unpacked blobs of each segment, from batches sorted by it."""
    at, held = None, []
    for b in batches:
        for seg, blob in zip(b.column("seg").to_pylist(), b.column("blob"), strict=True):
            if at is not None and seg != at:
                yield at, held
                held = []
            at = seg
            held.append(tuple(unpacked(blob.as_py(), columns)))
    if held:
        yield at, held


MANIFEST = "seg int, path string, n long"


def manifest(seg: int, path: str, n: int):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([path], pa.string()), pa.array([n], pa.int64())], ["seg", "path", "n"])


def files(df: DataFrame, path: str) -> tuple:
    """(segment, path, entries) of the files that successful tasks wrote; a row for each segment."""
    return tuple((int(r[0]), r[1], int(r[2])) for r in written(df, path).collect())


@lru_cache(maxsize=2)
def _vocabulary(segments: tuple, bits: int) -> Vocabulary:
    return Vocabulary(segments, bits)


@lru_cache(maxsize=4)
def _level(segments: tuple, width: int) -> Level:
    return Level(segments, width)


class Model:
    """Names of the levels' files; what a task needs to open them."""

    def __init__(self, n: int, v: int, bits: int, words: tuple, two: tuple = (), two_width: int = 1, three: tuple = (), three_width: int = 1):
        self.n, self.v, self.bits, self.words = n, v, bits, words
        self.two, self.two_width, self.three, self.three_width = two, two_width, three, three_width

    def vocabulary(self) -> Vocabulary:
        return _vocabulary(self.words, self.bits)

    def bigrams(self) -> Level:
        return _level(self.two, self.two_width)

    def trigrams(self) -> Level:
        return _level(self.three, self.three_width)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def documents(self, hashes: bytes, places: bytes, ends: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of a slice's documents: the first and one past the last, the ids of the slice's words (-1: unknown), and the documents' words as places among these and where each begins."""
        known = self.vocabulary().ids(unpacked(hashes, 1)[0].view(np.uint64))
        words, upto = unpacked(places, 1, False)[0], unpacked(ends, 1)[0]
        at = 0
        while at < len(upto):
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + WORDS, side="right")))
            yield at, to, known, words[before : upto[to - 1]], np.concatenate([[before], upto[at : to - 1]]) - before
            at = to


class Pairs:
    """The bigrams of some documents, each distinct one looked up once and in order."""

    def __init__(self, model: Model, known: np.ndarray, words: np.ndarray, starts: np.ndarray):
        two = model.bigrams()
        self.inner = np.ones(len(words), bool)
        self.inner[starts] = False
        here = np.flatnonzero(self.inner)
        order, first = sorted_pairs(words[here - 1], words[here])
        one = here[order[first]]
        #: places and ids of the two words, position in the level (or -1), and place among the first word's successors (or -1)
        self.second, self.a, self.b = words[one], known[words[one - 1]], known[words[one]]
        self.at = two.find(self.a, self.b)
        self.places = np.where(self.at >= 0, self.at - two.begin(self.a), -1)
        #: the distinct bigram that ends at each word, or -1
        self.of = np.full(len(words), -1, np.int64)
        self.of[here[order]] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        #: where a trigram can end
        self.ends = np.flatnonzero(self.inner[1:] & self.inner[:-1]) + 1


def log10(model: Model, known: np.ndarray, words: np.ndarray, starts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probability of each word in its context; `one`: of each of the slice's words as a unigram."""
    two, three, pairs = model.bigrams(), model.trigrams(), Pairs(model, known, words, starts)
    # of each distinct bigram: its own, or what its first word leaves
    low = np.where(pairs.at >= 0, two.prob(pairs.at), two.back(pairs.a) + one[pairs.second])
    # places without a bigram point at the last
    out = np.where(pairs.inner, np.append(low, 0.0)[pairs.of], one[words])
    first, second = pairs.of[pairs.ends - 1], pairs.of[pairs.ends]
    order, begin = sorted_pairs(first, second)
    first, second = first[order[begin]], second[order[begin]]
    context = pairs.at[first]
    found = three.find(context, pairs.places[second])
    value = np.where(found >= 0, three.prob(found), three.back(context) + low[second])
    out[pairs.ends[order]] = np.repeat(value, np.diff(np.append(begin, len(order))))
    return out


SLICE = "ids array<{}>, held array<boolean>, hashes binary, places binary, ends binary"


def sliced(rows: DataFrame, folder: str) -> DataFrame:
    """The rows (id, held, t) as a written table of slices of many documents."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for part in by_bytes(b, "t", TEXT):
                hashes, places, upto = split(part.column("t"))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "held")]
                blobs = [pa.array([x], pa.binary()) for x in (packed([hashes]), packed([places], False), packed([upto]))]
                yield pa.RecordBatch.from_arrays([*lists, *blobs], ["ids", "held", "hashes", "places", "ends"])

    return written(rows.mapInArrow(work, SLICE.format(rows.schema["id"].dataType.simpleString())), f"{folder}/slices")


def fit_vocabulary(table: DataFrame, folder: str, size: int) -> Model:
    """Counts the training words of the slices and writes the vocabulary; `size`: bytes of all texts."""
    bits = min(16, max(0, (-(-size // WORD_BYTES) - 1).bit_length()))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def rows() -> Iterator:
            hashes, counts = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
            held.clear()
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            first = groups(hashes)
            hashes, counts = hashes[first], np.add.reduceat(counts, first) if len(first) else counts
            top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cuts = groups(top).tolist() + [len(top)]
            blobs = [packed([hashes[lo:hi], counts[lo:hi]]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([int(top[lo]) for lo in cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["seg", "blob"])

        for b in batches:
            for out, hashes, places, ends in zip(*(b.column(c) for c in ("held", "hashes", "places", "ends")), strict=True):
                known, upto = unpacked(hashes.as_py(), 1)[0].view(np.uint64), unpacked(ends.as_py(), 1)[0]
                train = np.repeat(~out.values.to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], upto])))
                counts = np.bincount(unpacked(places.as_py(), 1, False)[0][train], minlength=len(known))
                held.append((known[counts > 0], counts[counts > 0]))
                if sum(len(h) for h, _ in held) > MAX_HELD:
                    yield from rows()
        if held:
            yield from rows()

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for seg, parts in by_segment(batches, 2):
            hashes, counts = np.concatenate([h for h, _ in parts]).view(np.uint64), np.concatenate([c for _, c in parts])
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            first = groups(hashes)
            total = np.add.reduceat(counts, first)
            row = manifest(seg, Vocabulary.build(f"{folder}/words", bits, hashes[first], total), len(first))
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([int(total.sum())], pa.int64())], [*row.schema.names, "tokens"])

    rows = table.select("held", "hashes", "places", "ends").mapInArrow(count, "seg int, blob binary").repartition(1 << bits, "seg").sortWithinPartitions("seg")
    made = written(rows.mapInArrow(build, f"{MANIFEST}, tokens long"), f"{folder}/words-manifest").collect()
    return Model(sum(r[3] for r in made), sum(r[2] for r in made), bits, tuple((int(r[0]), r[1], int(r[2])) for r in made))


def build_level(counted: DataFrame, entries: int, width: int, folder: str, totals, lower, min_count: int, last: bool = False) -> tuple:
    """Writes a level's files from the packed counts of its segments; totals(a, all counts of each context) gives the counts of contexts, lower(b) the followers and their log10 probabilities one order down."""

    def build(batches: Iterator) -> Iterator:
        for seg, parts in by_segment(batches, 3):
            a, b, c = merged(parts)
            first = groups(a)
            own = a[first]
            total = totals(own, np.add.reduceat(c, first)).astype(np.float64)
            b, under = lower(b)
            keep = (c >= min_count) & (b != OTHER)
            context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
            a, b, c, under, context = a[keep], b[keep], c[keep], under[keep], context[keep]
            if not len(a):
                continue
            used = groups(context)
            total = total[context[used]]
            each = np.diff(np.append(used, len(context)))
            rest = np.maximum(1 - np.add.reduceat(c - DISCOUNT, used) / total, 1e-12)
            prob = (c - DISCOUNT) / np.repeat(total, each) + np.repeat(rest, each) * 10**under
            yield manifest(seg, Level.build(folder, width, seg, a, b, np.log10(prob), np.log10(rest), last), len(a))

    rows = counted.repartition(max(1, -(-entries // SEGMENT)), "seg").sortWithinPartitions("seg")
    return files(rows.mapInArrow(build, MANIFEST), f"{folder}-manifest")


def fit(rows: DataFrame, folder: str, min_count: int = MIN_COUNT) -> tuple[Model, DataFrame]:
    """The model of the rows (id, held, t) that aren't held out, and the table of slices of all rows."""
    table = sliced(rows, folder)
    model = fit_vocabulary(table, folder, rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    fields = ["held", "hashes", "places", "ends"]
    columns = table.select(*fields)

    def train(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for held, *slice_ in zip(*(b.column(c) for c in fields), strict=True):
                out = held.values.to_numpy(zero_copy_only=False)
                for at, to, known, words, starts in model.documents(*(x.as_py() for x in slice_)):
                    n, keep = np.diff(np.append(starts, len(words))), ~out[at:to]
                    if keep.any():
                        yield known, words[np.repeat(keep, n)], np.cumsum(n[keep]) - n[keep]

    def width(contexts: int) -> int:
        return max(1, -(-contexts // max(1, -(-model.n // SEGMENT))))

    def bigrams(batches: Iterator) -> Iterator:
        held = Held(two_width)
        for known, words, starts in train(batches):
            inner = np.ones(len(words), bool)
            inner[starts] = False
            here, ids = np.flatnonzero(inner), known[words]
            yield from held.add(ids[here - 1], ids[here])
        yield from held.rows()

    two_width = model.two_width = width(model.v)
    unigram = lambda b: model.unigram(model.vocabulary().counts(b))
    model.two = build_level(columns.mapInArrow(bigrams, "seg int, blob binary"), model.n, two_width, f"{folder}/two", lambda a, _: model.vocabulary().counts(a), lambda b: (b, unigram(b)), min_count)

    n_two = sum(n for _, _, n in model.two)
    three_width = model.three_width = width(n_two)

    def trigrams(batches: Iterator) -> Iterator:
        held = Held(three_width)
        for part in train(batches):
            pairs = Pairs(model, *part)
            # a follower goes with the code of its probability one order down, which hangs on it alone
            coded = np.where(pairs.at >= 0, pairs.places << 16 | model.bigrams().codes(pairs.at), OTHER << 16)
            context, follower = pairs.at[pairs.of[pairs.ends - 1]], coded[pairs.of[pairs.ends]]
            live = context >= 0
            yield from held.add(context[live], follower[live])
        yield from held.rows()

    model.three = build_level(columns.mapInArrow(trigrams, "seg int, blob binary"), model.n, three_width, f"{folder}/three", lambda _, total: total, lambda b: (b >> 16, restored(b & 0xFFFF)), min_count, True)
    return model, table


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), text_of(text).alias("t"))
    model, table = fit(rows, run_dir(spark, "lm"), min_count)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for own, held, *slice_ in zip(*b.columns, strict=True):
                counts = None
                for at, to, known, words, starts in model.documents(*(x.as_py() for x in slice_)):
                    counts = model.vocabulary().counts(known) if counts is None else counts
                    one = model.unigram(counts)
                    sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                    cols = [np.diff(np.append(starts, len(words))), sums((counts[words] > 0).astype(np.int64)), np.full(to - at, model.n), sums(one[words]), sums(log10(model, known, words, starts, one))]
                    yield pa.RecordBatch.from_arrays([own.values[at:to], held.values[at:to], *map(pa.array, cols)], names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    return table.mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
