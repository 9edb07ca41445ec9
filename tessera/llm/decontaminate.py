"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items, at most about BLOCK_ITEMS at once, make an inverted index, in
order of their length and in blocks of BLOCK neighbours. Every document, with
the distinct terms of its whole text, queries the index for all items whose
score reaches the least that verification could accept. Sums of block maxima
skip blocks that can't reach it; in what remains WAND finds the items. Those
are verified on word shingles: MIN_OVERLAP of the whole, and MIN_PART of the
question (first half of the words) and of the answer (second half), have to be
in the text, wherever they stand.

The least score of an item is exact: with a share of MIN_OVERLAP of the
shingles in place, as many words can be missing at its two ends as shingles
are, and four fewer inside; the heaviest such loss is taken off the item's
score against itself. So retrieval loses nothing that verification
would accept. Null and empty texts and items match nothing, an item below
five words is one shingle, null ids and repeated rows stay as they are, other
columns are given back as they are; empty tables are fine. Item ids are whole
numbers. The items are a query set of bounded size: they pass through the
driver, BLOCK_ITEMS at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import fresh, text_of

WORDS = re.compile(r"\w+")
SHINGLE, MIN_OVERLAP, MIN_PART = 5, 0.8, 0.5
#: BM25's constants, items of a block, items of an index.
K1, B, BLOCK, BLOCK_ITEMS = 1.2, 0.75, 8, 20_000
#: Terms in more than this share of the items only ever add to a text's bound as a whole.
COMMON = 0.05


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """Inverted index of test items; an impact is a share of the least score that the item can be accepted with, so 1 is the threshold."""

    def __init__(self, items: list[tuple[int, str]]):
        read = [(i, WORDS.findall(t.lower())) for i, t in items]
        self.items = sorted(((i, w) for i, w in read if w), key=lambda x: (len(x[1]), x[0], x[1]))
        n = len(self.items)
        mean = sum(len(w) for _, w in self.items) / max(n, 1)
        df = Counter(t for _, w in self.items for t in set(w))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.term = {t: k for k, t in enumerate(df)}
        self.docs: list[list[int]] = [[] for _ in df]
        self.impacts: list[list[float]] = [[] for _ in df]
        self.parts = []
        blocks = -(-n // BLOCK)
        maxima: list[dict[int, float]] = [{} for _ in df]
        common = {t for t, d in df.items() if d > max(1.0, COMMON * n)}
        #: all terms of a block's items
        self.terms_of: list[set[int]] = [set() for _ in range(blocks)]
        slack = np.zeros(blocks)
        for k, (_, w) in enumerate(self.items):
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(w).items()}
            # a shingle that is there has at least one term, however much may be missing
            least = max(sum(impact.values()) - self.heaviest_loss(w, impact), min(impact.values()))
            for t, x in impact.items():
                term, x = self.term[t], x / least
                self.docs[term].append(k)
                self.impacts[term].append(x)
                if t not in common:
                    maxima[term][k // BLOCK] = max(maxima[term].get(k // BLOCK, 0.0), x)
            half = (len(w) + 1) // 2
            self.parts.append((shingles(w), shingles(w[:half]), shingles(w[half:]) or shingles(w)))
            self.terms_of[k // BLOCK].update(self.term[t] for t in impact)
            slack[k // BLOCK] = max(slack[k // BLOCK], sum(x for t, x in impact.items() if t in common) / least)
        self.need = 1 - 1e-9 - slack
        #: rare terms' block maxima, term after term
        self.first = np.concatenate([[0], np.cumsum([len(m) for m in maxima] + [0])])
        self.block = np.array([b for m in maxima for b in m], np.int64)
        self.most = np.array([x for m in maxima for x in m.values()])
        self.term_most = [max(x) for x in self.impacts]

    @staticmethod
    def heaviest_loss(w: list[str], impact: dict[str, float]) -> float:
        """The most that may be missing from an item's score while MIN_OVERLAP of its shingles are there."""
        lost = len(shingles(w)) - math.ceil(MIN_OVERLAP * len(shingles(w)) - 1e-9)
        # equal shingles are one: each of them may hide as many places as it has
        lost += max(0, len(w) - SHINGLE + 1 - len(shingles(w)))
        lost = min(lost, len(w))
        ends = [max(sum(impact[t] for t in {*w[:head], *w[len(w) - (j - head) :]}) for head in range(j + 1)) for j in range(lost + 1)]
        # k words inside cost SHINGLE - 1 shingles more than k; they may be the heaviest, and the rest be lost at the ends
        heavy = np.concatenate([[0.0], np.cumsum(sorted(impact.values(), reverse=True))])
        inside = [heavy[min(k, len(heavy) - 1)] + ends[lost - SHINGLE + 1 - k] for k in range(1, lost - SHINGLE + 2)]
        return max([ends[lost], *inside])

    def blocks(self, terms: np.ndarray) -> np.ndarray:
        """The blocks whose bound for these distinct terms reaches the threshold."""
        count = self.first[terms + 1] - self.first[terms]
        flat = np.repeat(self.first[terms], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        bound = np.bincount(self.block[flat], self.most[flat], len(self.need))
        # blocks that common terms alone could fill have no need
        return np.flatnonzero(bound >= self.need)

    def retrieve(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """(item, score) of all items of a block at the threshold or above for these distinct terms, by WAND."""
        first, end = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            p = self.seek(t, 0, first)
            if p < len(self.docs[t]) and self.docs[t][p] < end:
                # the term's largest impact within the block bounds it there
                q = self.seek(t, p, end)
                cursors.append([self.docs[t][p], p, t, max(self.impacts[t][p:q]), q])
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= 1 - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors if c[0] == item)
                if score >= 1 - 1e-9:
                    found.append((item, score))
                item += 1
            # what lies before the pivot can't reach the threshold
            moved = []
            for c in cursors:
                if c[0] < item:
                    c[1] = self.seek(c[2], c[1], item)
                    if c[1] >= c[4]:
                        continue
                    c[0] = self.docs[c[2]][c[1]]
                moved.append(c)
            cursors = moved
        return found

    def seek(self, term: int, at: int, item: int) -> int:
        """The first posting from `at` on whose item is `item` or later."""
        docs = self.docs[term]
        lo, hi = at, len(docs)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if docs[mid] < item else (lo, mid)
        return lo

    def verify(self, item: int, whole_text: set[tuple[str, ...]]) -> bool:
        whole, question, answer = self.parts[item]
        share = lambda s: len(s & whole_text) / len(s)
        return share(whole) >= MIN_OVERLAP and share(question) >= MIN_PART and share(answer) >= MIN_PART

    def matches(self, text: str) -> dict[int, float]:
        """Verified items of a text and the score of each."""
        words = WORDS.findall(text.lower())
        if not words or not self.items:
            return {}
        have = {k for k in map(self.term.get, set(words)) if k is not None}
        hit = self.blocks(np.fromiter(have, np.int64, len(have)))
        got = [x for block in hit.tolist() for x in self.retrieve(sorted(have & self.terms_of[block]), block)]
        out: dict[int, float] = {}
        if got:
            held = shingles(words)
            short = {len(x) for k, _ in got for part in self.parts[k] for x in part} - {SHINGLE}
            for n in short:
                held |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            for k, x in got:
                if self.verify(k, held):
                    item = self.items[k][0]
                    out[item] = max(out.get(item, 0.0), float(x))
        return out


def matcher(items, at: int, name: str):
    """What adds the verified items of the text in the column numbered `at`; `items` is a broadcast list."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(items.value)
        kind = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            made = [[{"item": i, "score": x} for i, x in sorted(index.matches(t).items())] if t else [] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], [*b.schema.names, name])

    return work


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of `docs`, and as the last one `items` (with underscores before it where `docs` has that name): the verified items (id, score) by id."""
    spark = docs.sparkSession
    numbered = items.where(F.col("text").isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col("text").alias("item_text"))
    n = numbered.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    kind = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType())]))
    name, at = fresh(docs, "items"), docs.columns.index(text)
    out, made = docs, []
    for k in range(blocks):
        # BLOCK_ITEMS items or so at once: the test set is a query set against all rows, in blocks
        part = [(r[0], r[1]) for r in numbered.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == k).collect()]
        made.append(fresh(out, f"items_{k}"))
        out = out.mapInArrow(matcher(spark.sparkContext.broadcast(part), at, made[-1]), T.StructType([*out.schema.fields, T.StructField(made[-1], kind)]))
    return out.select(*docs.columns, F.array_sort(reduce(F.concat, map(F.col, made))).alias(name))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, contaminated, n_items, items (ids, comma-joined in order) and score (the best) of every row."""
    slim = docs.select(F.col(id_col).alias("id"), text_of(text).alias("t"))
    found = contaminated_pairs(slim, items, "id", "t", item_col)
    ids = F.transform("items", lambda x: x["item"])
    return found.select(
        F.col("id").alias(id_col),
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(ids, ",").alias("items"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
