"""Toxicity by Levenshtein automata over a lexicon trie.

Terms, and stems that many words of toxic texts begin with, are learnt from
a bounded sample of labelled rows by greedy covering. They go into one trie;
the automaton of all terms within their allowed edits (insertions, deletions,
substitutions, swaps of neighbours) is determinised as words are read, so
misspelled terms are caught in one pass over a word's letters. Each hit is
weighed by a window of words around it: quotation marks together with a verb
of reporting speak for quotation, words of address for abuse. A logistic
curve fitted on the same sample turns the weights into a score.

Null texts are empty ones and score the base rate of texts without hits, null
ids and repeated rows stay as they are, null labels are left out, other
columns are given back as they are. Without a labelled toxic row every score
is near zero.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import by_bytes, fresh, release, text_of

#: Labelled rows of each class that the lexicon and the curve are fitted on, at most, and the longest such text.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2_000, 6_000, 20_000
#: Documents that a term has to explain, its least ratio of rates, lengths of stems.
MIN_DOCS, MIN_RATIO, STEMS = 3, 10.0, range(4, 10)
#: What an edit leaves of a term's weight.
EDIT = 0.6
#: Words before and after a hit that make its context.
WINDOW = 6
#: Words a worker remembers, and states of its automaton; beyond that it starts anew.
MAX_MEMO, MAX_STATES = 500_000, 100_000
#: Bytes of the texts that a worker takes out of a batch at once.
SLICE_BYTES = 4 << 20

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
#: Letters that digits and signs stand for in disguised words.
LEET = str.maketrans("013457@$!", "oieastasi")
QUOTES = "\"'“”„«»‘’‹›"
#: Words that report speech or speak about a word, and words of address.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes quoting reported reports word words term terms dit disait écrit appelé mot mots sagte sagt schrieb nannte wort dijo dice escribió llamó palabra palabras".split())
ADDRESS = frozenset("you your you're youre u ur are tu te vous ton toi du dich dein ihr eres usted tú".split())


def allowed(length: int) -> int:
    """Edits that a term of so many letters may have."""
    return 0 if length < 5 else 1 if length < 8 else 2


class LexiconAutomaton:
    """Accepts the words within the allowed edits of a term, and those that begin with a stem; each edit takes EDIT off an exact term's weight."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[int, float]] = {}
        self.stem: dict[int, float] = {}
        for words, at_end in ((terms, self.term), (stems, self.stem)):
            for word, weight in sorted(words.items()):
                node = 0
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                at_end[node] = (allowed(len(word)), weight) if at_end is self.term else weight
        #: most edits that any term below a node allows
        self.room = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.room[node] = max([self.term.get(node, (0,))[0], *(self.room[c] for c in self.children[node].values())])
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.final: list[float] = []
        self.sure: list[float] = []
        self.start = self.state({(0, 0, None)})

    def state(self, items: set[tuple[int, int, str | None]]) -> int:
        """The number of the state of these (node, edits, letter still to come before the node in a swap), closed under deletions."""
        todo = list(items)
        while todo:
            node, e, held = todo.pop()
            if held:
                continue
            for child in self.children[node].values():
                if e < self.room[child] and (child, e + 1, None) not in items:
                    items.add((child, e + 1, None))
                    todo.append((child, e + 1, None))
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.final.append(max((w * EDIT**e for n, e, h in key if not h and n in self.term for k, w in [self.term[n]] if e <= k), default=0.0))
            self.sure.append(max((self.stem[n] for n, e, h in key if not h and not e and n in self.stem), default=0.0))
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        out: set[tuple[int, int, str | None]] = set()
        for node, e, held in self.sets[at]:
            if held:  # second half of a swap
                if c == held:
                    out.add((node, e, None))
                continue
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e, None))
                elif e < self.room[child]:
                    out.add((child, e + 1, None))
                    if c in self.children[child] and e < self.room[self.children[child][c]]:
                        out.add((self.children[child][c], e + 1, letter))
            if e < self.room[node]:
                out.add((node, e + 1, None))
        return self.state(out) if out else -1

    def match(self, word: str) -> float:
        """Weight of the best term or stem for the word, or 0."""
        at, best = self.start, 0.0
        for c in word:
            best = max(best, self.sure[at])
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self.step(at, c)
            if to < 0:
                return best
            at = to
        return max(best, self.sure[at], self.final[at])


def bare(token: str) -> str:
    return EDGE.sub("", token)


class Scorer:
    """Scores texts with a learnt lexicon; `safe` words are no misspellings."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], safe: Iterable[str], curve: list[float]):
        self.automaton = LexiconAutomaton(terms, stems)
        self.terms, self.stems, self.safe, self.curve = terms, stems, frozenset(safe), curve
        self.memo: dict[str, float] = {}

    def weight(self, token: str) -> float:
        """Weight of a lower-case token as it stands, without signs inside, or with its disguise taken off."""
        word = bare(token)
        if not word or word in self.safe:
            return 0.0
        found = self.automaton.match(word)
        if not found and not word.isalpha():
            for other in (INNER.sub("", word), bare(token.translate(LEET)), INNER.sub("", token.translate(LEET))):
                if other != word and other not in self.safe and len(other) > 3:
                    found = max(found, self.automaton.match(other))
        return found

    def hits(self, text: str) -> list[float]:
        """Weights of the hits, each changed by its context."""
        tokens = text.lower().split()
        memo = self.memo
        new = set(tokens).difference(memo)
        if new:
            if len(memo) > MAX_MEMO or len(self.automaton.sets) > MAX_STATES:
                memo.clear()
                self.automaton = LexiconAutomaton(self.terms, self.stems)
                new = set(tokens)
            for t in new:
                memo[t] = self.weight(t)
        weights = list(map(memo.__getitem__, tokens))
        if not any(weights):
            return []
        return [w * self.context(tokens, i) for i, w in enumerate(weights) if w]

    def context(self, tokens: list[str], i: int) -> float:
        """Below 1 for a quotation, above for abuse."""
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        words = {bare(t) for t in around}
        before = sum(t.count(q) for t in tokens[max(0, i - WINDOW) : i] for q in QUOTES) + (tokens[i][:1] in QUOTES)
        after = sum(t.count(q) for t in tokens[i + 1 : i + WINDOW + 1] for q in QUOTES) + (tokens[i].rstrip(".,;:!?")[-1:] in QUOTES)
        if before and after and words & REPORTING:
            return 0.35
        return 1.25 if words & ADDRESS else 1.0

    def features(self, text: str) -> list[float]:
        total = sum(self.hits(text))
        # the first sure hit counts by itself, as texts with one only may be rare among the labelled ones
        return [1.0, min(total, 1.0) + 0.1 * min(max(total - 1.0, 0.0), 4.0)]

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(a * b for a, b in zip(self.curve, self.features(text), strict=True))))))


def doc_features(text: str) -> set[str]:
    """A text's words, and their beginnings with a `*`."""
    words = {w for w in map(bare, set(text.lower().split())) if 2 < len(w) < 40}
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def sketch(text: str) -> tuple:
    """What near copies mostly share: the smallest hashes of the text's words."""
    return tuple(sorted({zlib.crc32(w.encode()) for w in text.lower().split()})[:4])


def learn(rows: list[tuple[str, int]]) -> Scorer:
    """Lexicon and curve from labelled texts."""
    seen: set = set()
    rows = [r for r in rows if not ((key := (sketch(r[0]), r[1])) in seen or seen.add(key))]
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    docs: dict[str, set[int]] = defaultdict(set)
    for i, t in enumerate(toxic):
        for f in doc_features(t):
            docs[f].add(i)
    docs = {f: s for f, s in docs.items() if len(s) >= MIN_DOCS}
    of_clean: Counter = Counter()
    clean_words: dict[str, int] = {}  # and the first text that has the word
    for i, t in enumerate(clean):
        found = doc_features(t)
        of_clean.update(f for f in found if f in docs)
        for f in found:
            if f[-1] != "*":
                clean_words.setdefault(f, i)
    ratio = {f: len(s) / max(len(toxic), 1) / ((of_clean[f] + 0.5) / (len(clean) + 1)) for f, s in docs.items()}
    left, chosen, open_ = {f: set(s) for f, s in docs.items() if ratio[f] >= MIN_RATIO}, [], set(range(len(toxic)))
    least = max(MIN_DOCS, math.ceil(0.002 * len(toxic)))
    while left:
        gains = {f: len(s) for f, s in left.items()}
        best = max(gains.values())
        if best < least:
            break
        near = [f for f, g in gains.items() if g >= 0.9 * best]
        # a word before a stem, then the longest stem, then the alphabet
        pick = min(near, key=lambda f: (f[-1] == "*", -len(f) if f[-1] == "*" else -gains[f], f))
        chosen.append(pick)
        gone = set(left.pop(pick))
        open_ -= gone
        left = {f: s - gone for f, s in left.items()}
        left = {f: s for f, s in left.items() if len(s) >= least}
    # terms that stand beside chosen ones in nearly every text count too: words of ten times their rate in many texts
    common = max(least, 0.05 * len(toxic))
    chosen += [f for f in sorted(docs) if f[-1] != "*" and f not in chosen and len(docs[f]) >= common and ratio[f] >= 10 * MIN_RATIO and not any(f.startswith(c[:-1]) for c in chosen if c[-1] == "*")]
    weigh = lambda f: min(1.0, math.log(ratio[f]) / math.log(100.0))
    terms = {f: weigh(f) for f in chosen if f[-1] != "*"}
    stems = {f[:-1]: weigh(f) for f in chosen if f[-1] == "*"}
    probe = LexiconAutomaton(terms, {})
    near = {w: n for w, n in clean_words.items() if w not in terms and probe.match(w)}
    scorer = Scorer(terms, stems, near, [0.0, 0.0])
    if not toxic:
        scorer.curve = [math.log(0.5 / (len(clean) + 1)), 0.0]
        return scorer
    # the curve is fitted on clean texts whose own words aren't known as safe yet, as those to come won't be
    half = len(clean) // 2
    fitting = Scorer(terms, stems, [w for w, i in near.items() if i < half], scorer.curve)
    x = np.array([fitting.features(t) for t in toxic + clean[half:]])
    y = np.array([1.0] * len(toxic) + [0.0] * (len(clean) - half))
    b = np.zeros(2)
    for _ in range(50):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        grad = x.T @ (p - y) + 0.01 * b
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), grad)
    scorer.curve = b.tolist()
    return scorer


def held_out(id_col: str, folds: int = 5):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Scorer:
    """Fits on a bounded sample of labelled rows: `max_toxic` and `max_clean` ids that aren't held out, by their hash, with one text each of at most `max_chars` characters."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label) > 0).cast("int").alias("y")).where(~held_out("_id", folds))
    chosen = known.where("y = 1").orderBy(F.xxhash64("_id"), "_id").limit(max_toxic).union(known.where("y = 0").orderBy(F.xxhash64("_id"), "_id").limit(max_clean))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text).alias("t")).where(F.length("t") <= max_chars)
    # one text for each of max_toxic + max_clean ids, the first by hash, however many rows an id has
    first = F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(first).select("_id", "t", "y").collect()
    return learn([(r[1], r[2]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))])


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, and as the last one score (with underscores before it where `docs` has that name)."""
    parts = (scorer.terms, scorer.stems, sorted(scorer.safe), scorer.curve)
    name, at = fresh(docs, "score"), docs.columns.index(text)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        own = Scorer(*parts)
        for batch in batches:
            for b in by_bytes(batch, at, SLICE_BYTES):
                made = pa.array([own.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
