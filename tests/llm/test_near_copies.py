import random

import corpus_pipeline
from tessera.llm import near_copies as n
from tessera.llm.simhash import majority


def brute_kept(rows):
    """Smallest ids of the classes that all pairs of shingle sets make."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted(set(label.values())), links


def test_near_dedup_finds_edited_copies(spark, make_docs):
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(5000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(40, 300))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(5):  # some above 0.8, some below
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.choice([0.004, 0.01, 0.02, 0.025, 0.04])))):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    step = [word() for _ in range(200)]
    for k in range(30):  # a chain: neighbours are alike, its ends aren't
        rows.append((len(rows), " ".join(step)))
        step[6 * k : 6 * k + 3] = [word() for _ in range(3)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    want, links = brute_kept(rows)
    assert len(links) > 200 and len(want) > 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs(rows), "").select("doc_id").collect()) == want


def test_texts_below_the_similarity_stay(spark, make_docs):
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(common + [f"o{i}x{k}" for k in range(120)])) for i in range(12)]
    assert corpus_pipeline.near_dedup(spark, make_docs(rows), "").count() == 12
    assert not n.alike(n.shingle_set(rows[0][1].encode()), n.shingle_set(rows[1][1].encode()))


def test_odd(odd_docs, make_docs, spark):
    kept = corpus_pipeline.near_dedup(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert n.classes(make_docs([])).count() == 0


def test_simhash_finds_and_sets_decide(spark, make_docs, monkeypatch):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join([*b[:-1], "other"])) for i, b in enumerate(base)]
    # equal fingerprints: what is repeated decides all bits, but most shingles differ
    often = " ".join(["one two three four five"] * 400)
    rows += [(200 + k, " ".join([often, *(f"t{k}x{i}" for i in range(20))])) for k in range(2)]
    assert len({majority(n.shingle_hashes(t.encode())) for i, t in rows if i >= 200}) == 1
    want, _ = brute_kept(rows)
    assert {200, 201} <= set(want)
    # without any band SimHash gives the links
    real = n.banded
    monkeypatch.setattr(n, "banded", lambda distinct: real(distinct).limit(0))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs(rows), "").select("doc_id").collect()}
    near = {i for i, b in enumerate(base) if (majority(n.shingle_hashes(rows[i][1].encode())) ^ majority(n.shingle_hashes(rows[20 + i][1].encode()))).bit_count() <= 4}
    assert len(near) > 10 and {100 + i for i in near}.isdisjoint(kept) and set(want) <= kept
