import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash


def brute(fps):
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        new = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= 4) for f in fps}
        if new == label:
            break
        label = new
    return label


def test_tree_reaches_every_ball():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    tree = simhash.Tree()
    tree.grow(fps[:1000], 4)
    for leaf in (0, 3, 7):
        tree.grow(fps[tree.home(fps) == leaf], 2, leaf)
    near = fps.copy()
    for _ in range(simhash.RADIUS):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    assert sorted(set(tree.home(fps).tolist())) == list(range(tree.leaves)) and tree.leaves > 16
    reached = {leaf: set(at.tolist()) for leaf, at in tree.visits(fps)}
    assert len(reached) == tree.leaves
    assert all(i in reached[int(h)] for who in (fps, near) for i, h in enumerate(tree.home(who)))


def test_shard_finds_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "CANDIDATES", 7)
    monkeypatch.setattr(simhash, "QUERIES", 5)
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 10, 150, dtype=np.uint64) << np.uint64(20))
    stored, guests = fps[::2], fps[1::2]
    shard = simhash.Shard(stored)
    shard.link_stored()
    a, b = shard.link_guests(guests)
    linked = [g for g in guests.tolist() if any((g ^ s).bit_count() <= 4 for s in stored.tolist())]
    assert a.tolist() == linked and all((x ^ y).bit_count() <= 4 for x, y in zip(a.tolist(), b.tolist(), strict=True))
    # guests join up what they link to
    want = brute(fps.tolist())
    classes = {}
    for x in stored.tolist():
        classes.setdefault(want[x], []).append(x)
    members, root = shard.stars()
    label = dict(zip(stored.tolist(), stored.tolist(), strict=True)) | dict(zip(members.tolist(), root.tolist(), strict=True))
    alone = simhash.Shard(stored)
    alone.link_stored()
    members, root = alone.stars()
    assert dict(zip(members.tolist(), root.tolist(), strict=True)) == {x: w for x, w in brute(stored.tolist()).items() if x != w}
    assert all(want[x] == want[y] for x, y in label.items()) and len(set(label.values())) <= len(set(stored.tolist()) - set(members.tolist()))


def plain_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        w = [f"{rng.choice('aÄbçD')}w{rng.randrange(400)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(4):
            texts.append(rng.choice([" ", "\t", "  "]).join(w))
            w[rng.randrange(len(w))] = rng.choice(["X", "y", "zz"])
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    label = brute(set(fps.values()))
    first = {}
    for i, f in fps.items():
        first[label[f]] = min(i, first.get(label[f], i))
    assert got == {i: (f"{f:016x}", first[label[f]]) for i, f in fps.items()}
    assert len(first) < len(set(fps.values()))


def test_links_are_complete(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:30].tolist():  # chains of near ones
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                s ^= 1 << b
            fps.add(s)
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(signed))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute(fps)
    groups = {}
    for f in fps:
        key = got.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64)))
        groups.setdefault(key, set()).add(f)
    by = {}
    for f, w in want.items():
        by.setdefault(w, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by.values()))


def test_documents(odd_docs, make_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[6].component_id == 1
    assert by[7].component_id == 4 and by[None].component_id is None
    assert simhash.near_duplicates(make_docs([])).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]


def test_kept_rows_are_found_without_hash_tables(make_docs):
    kept = simhash.keep_one(make_docs([(1, "a b c d e"), (2, "a b c d e"), (3, "x y"), (4, None)]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # a task that writes one file of several partitions would hold all their tables to its end
    assert "SortMergeJoin" in plan and "HashJoin" not in plan
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [1, 3, 4]
