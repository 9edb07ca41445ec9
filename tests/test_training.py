import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tfidf
from tessera.plans import tuning


def plain_tune(scores, gold, k, grid, rounds=3):
    def f1(pred):
        m = np.zeros((k, k), int)
        np.add.at(m, (gold, pred), 1)
        return tuning.f1_per_class(m)

    grid = grid[np.argsort(np.abs(grid), kind="stable")]
    o = np.zeros(k)
    base = best = f1(scores.argmax(1)).mean()
    for r in range(rounds):
        for c in range(k):
            top, at = -1.0, o[c]
            for g in grid:
                t = o.copy()
                t[c] = g
                v = f1((scores - t).argmax(1))
                v = v[c] if r == 0 else v.mean()
                if v > top:
                    top, at = v, g
            o[c] = at
        macro = f1((scores - o).argmax(1)).mean()
        if r and macro <= best + 1e-6:
            break
        best = max(best, macro)
    o = np.round(o - o.mean(), 4)
    return o if f1((scores - o).argmax(1)).mean() >= base else np.zeros(k)


def test_tuning_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    k = 3
    gold = rng.integers(0, k, 300)
    scores = np.round(np.log(rng.dirichlet(np.ones(k), 300) + 0.25 * np.eye(k)[gold] + [0.4, 0, 0]), 2)
    rows = spark.createDataFrame([(i, int(g), s.tolist()) for i, (g, s) in enumerate(zip(gold, scores, strict=True))], "row_id int, gold int, scores array<double>").cache()
    grid = tuning.offset_grid(2.0, 0.5)
    got, info = tuning.tune_offsets(rows, k, grid, 2)
    assert np.allclose(got, plain_tune(scores, gold, k, grid, 2)) and info["tuned"] >= info["argmax"]
    assert tuning.transfer_estimate(rows.limit(100), k) is None
    assert set(tuning.transfer_estimate(rows, k, tuning.offset_grid(1.0, 1.0), 1)) >= {"in_sample", "held_out", "optimism"}


def test_grid_and_guard():
    g = tuning.offset_grid()
    assert len(g) == 49 and 0.0 in g and g[0] == -6 and g[-1] == 6
    for bad in ((0, 1), (1, 0), (1, 2)):
        with pytest.raises(ValueError):
            tuning.offset_grid(*bad)
    assert tuning.guarded(np.array([1.0]), {"held_out": -0.1}).tolist() == [0.0] and tuning.guarded(np.array([1.0]), None).tolist() == [1.0]


def char_wb(text, lo=3, hi=5):
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            yield w[:n]
            for i in range(1, len(w) - n + 1):
                yield w[i : i + n]
            if n >= len(w):
                break


def test_tfidf(spark):
    texts = ["int Foo bar foo", "foo(bar) bar_1 x", "", "a bc défi  int", "int int foo"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    grams = {r.doc_id: Counter(r.g) for r in df.select("doc_id", tfidf.char_grams(F.col("text")).alias("g")).collect()}
    assert grams == {i: Counter(char_wb(t)) for i, t in enumerate(texts)}
    got = {(r.doc_id, r.term): r.weight for r in tfidf.tfidf(df, "doc_id", tfidf.word_grams(F.col("text")), 2).collect()}
    import re

    toks = [re.findall(tfidf.TOKEN, t.lower()) for t in texts]
    tf = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in toks]
    dfc = Counter(t for c in tf for t in c)
    want = {}
    for i, c in enumerate(tf):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + dfc[t])) + 1) for t, n in c.items() if dfc[t] >= 2}
        size = math.sqrt(sum(x * x for x in v.values()))
        want |= {(i, t): x / size for t, x in v.items()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_terms_are_counted_where_their_row_lies(spark):
    counts = tfidf.counted(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "doc_id int, text string"), "doc_id", tfidf.word_grams(F.col("text")))
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "a b", 1), (1, "b", 1), (1, "b a", 1), (4, "b", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_one_document(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b"), (None, "c"), (None, "c"), (2, "a")], "doc_id int, text string")
    counts = tfidf.counted(rows, "doc_id", tfidf.word_grams(F.col("text")))
    got = [tuple(r) for r in counts.collect()]
    assert len(got) == 5 and set(got) == {(1, "a", 1), (1, "a b", 1), (1, "b", 2), (2, "a", 1), (None, "c", 2)}
