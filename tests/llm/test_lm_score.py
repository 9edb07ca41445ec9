import math
import zlib
from collections import Counter

import numpy as np

from tessera.llm import eftrie, lm_score


def test_elias_fano(monkeypatch):
    rng = np.random.default_rng(2)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 1 << 20), (3000, 3001), (500, 1 << 64), (5000, 64), (4000, 1 << 12)):
        top = min(u, (1 << 63) - 1)
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64)) if u != 3001 else np.arange(n, dtype=np.uint64)
        ef = eftrie.EliasFano(**eftrie.encode(v, u))
        assert (ef.at(np.arange(n)) == v).all()
        asked = np.concatenate([v, rng.integers(0, top, 200, dtype=np.uint64), np.array([0, top - 1], np.uint64)])
        count, equal = ef.search(asked)
        assert (count == np.searchsorted(v, asked, side="right")).all() and (equal == np.isin(asked, v)).all()


def test_elias_fano_of_one_crowded_place():
    v = np.concatenate([np.arange(70_000), [10**12], 10**12 + np.arange(3000)]).astype(np.uint64)
    v.sort()
    ef = eftrie.EliasFano(**eftrie.encode(v, 1 << 41))
    asked = np.concatenate([v, v + np.uint64(1), np.array([1 << 41], np.uint64)])
    count, equal = ef.search(asked)
    assert (count == np.searchsorted(v, asked, side="right")).all() and (equal == np.isin(asked, v)).all()
    assert (ef.at(np.arange(len(v))) == v).all()


def test_level(tmp_path, monkeypatch):
    monkeypatch.setattr(eftrie, "CHUNK", 5)
    c, f = np.array([0, 0, 3, 3, 3, 9]), np.array([2, 5, 0, 1, 7, 4])
    path = eftrie.Level.build(f"file://{tmp_path}", 10, 0, c, f, np.full(6, -1.5), np.array([-0.5, -0.25, -1.0]))
    other = eftrie.Level.build(f"file://{tmp_path}", 10, 2, np.array([21, 21]), np.array([0, 3]), np.full(2, -2.5), np.array([-0.75]))
    level = eftrie.Level(((0, path, 6), (2, other, 2)), 10)
    c, f = np.append(c, [21, 21]), np.append(f, [0, 3])
    pairs = [(a, b) for b in range(-1, 9) for a in range(-1, 32)]
    got = level.find(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [next((i for i in range(8) if (c[i], f[i]) == p), -1) for p in pairs]
    assert level.begin(c).tolist() == [0, 0, 2, 2, 2, 5, 6, 6]
    assert np.allclose(level.back(np.array([0, 1, 3, 9, -1, 15, 21])), [-0.5, 0, -0.25, -1, 0, 0, -0.75], atol=1e-3)
    assert np.allclose(level.prob(np.array([7, -1, 0])), [-2.5, 0, -1.5], atol=1e-3)


def test_packed_columns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        a, b = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2), rng.integers(0, 1 << 40, n)
        x, y = lm_score.unpacked(lm_score.packed([a, b]), 2)
        assert (x.view(np.uint64) == a).all() and (y == b).all()


def test_split_is_that_of_bytes():
    import pyarrow as pa

    texts = ["", " ", "a B\tc", "\x0bx\x0c y\r\n", "Ünï ÇA\x1cz\x85w\xa0v", "a  a", " a", "a "]
    hashes, places, upto = lm_score.split(pa.array(["no", *texts]).slice(1))
    want = [[*t.encode().lower().split(), b"\n"] for t in texts]
    assert np.diff(np.concatenate([[0], upto])).tolist() == list(map(len, want))
    assert (hashes[places] == lm_score.word_hashes([w for x in want for w in x])).all()


def brute(docs, k, d=0.75):
    tok = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, w in tok:
        if not held(i):
            c1.update(w), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c1.values()), len(c1)
    k2, k3 = ({g: c for g, c in x.items() if c >= k} for x in (c2, c3))
    m2, m3 = Counter(), Counter()
    for g, c in k2.items():
        m2[g[0]] += c - d
    for g, c in k3.items():
        m3[g[:2]] += c - d
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    p2 = lambda a, w: max(k2.get((a, w), 0) - d, 0) / c1[a] + (1 - m2[a] / c1[a]) * p1(w) if a in m2 else p1(w)
    p3 = lambda a, b, w: max(k3.get((a, b, w), 0) - d, 0) / c2[a, b] + (1 - m3[a, b] / c2[a, b]) * p2(b, w) if (a, b) in m3 else p2(b, w)
    for i, w in tok:
        yield i, held(i), len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p1(x) if j == 0 else p2(w[0], x) if j == 1 else p3(w[j - 2], w[j - 1], x)) for j, x in enumerate(w))


def test_scores(make_docs, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"W{x}" for x in rng.zipf(1.6, rng.integers(0, 60)) if x < 90)) for i in range(150)] + [(None, "w1 w2"), (7, None), (7, None), (8, "unseen w1 w1\x0bw2")]
    for segment, held in ((4_000_000, 4_000_000), (40, 50)):
        monkeypatch.setattr(lm_score, "SEGMENT", segment)
        monkeypatch.setattr(lm_score, "MAX_HELD", held)
        monkeypatch.setattr(lm_score, "WORD_BYTES", 1000 if held == 50 else 1 << 26)
        got = sorted((tuple(r) for r in lm_score.score(make_docs(docs), min_count=3).collect()), key=repr)
        for g, w in zip(got, sorted(brute(docs, 3), key=repr), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[6] - w[6]) < 1e-3 * w[2]


def test_odd(odd_docs, make_docs):
    assert lm_score.score(odd_docs).count() == 9 and lm_score.score(make_docs([])).count() == 0


def test_default_keeps_every_ngram(make_docs):
    docs = [(i, f"once{i} seen words{i} follow each{i} other") for i in range(40)] + [(100 + i, f"once{i} seen words{i} follow") for i in range(40)]
    got = sorted((tuple(r) for r in lm_score.score(make_docs(docs)).collect()), key=repr)
    for g, w in zip(got, sorted(brute(docs, 1), key=repr), strict=True):
        assert g[:5] == w[:5] and abs(g[6] - w[6]) < 1e-3 * w[2]


def test_a_slice_asks_each_segment_once():
    import pyarrow as pa

    text = " ".join(f"w{i % 5000}" for i in range(5000))
    hashes, places, upto = lm_score.split(pa.array([text] * (lm_score.TEXT // len(text))))
    slice_ = lm_score.packed([hashes]), lm_score.packed([places], False), lm_score.packed([upto])
    assert len(places) > 1_200_000
    assert [(at, to) for at, to, *_ in lm_score.Model(0, 0, 0, ()).documents(*slice_)] == [(0, len(upto))]
