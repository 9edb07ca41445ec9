import random

from tessera.llm import decontaminate as d

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
ITEMS = [(i, " ".join(RNG.choice(VOCAB) for _ in range(RNG.randrange(3, 40)))) for i in range(120)]


def test_wand_retrieves_all_above_threshold():
    index = d.Index(ITEMS)
    for _ in range(150):
        words = RNG.choice(ITEMS)[1].split() + [RNG.choice(VOCAB) for _ in range(20)]
        terms = sorted({index.term[w] for w in RNG.sample(words, len(words) * 3 // 4) if w in index.term})
        got = {}
        for block in range(-(-len(index.items) // d.BLOCK)):
            got |= dict(index.retrieve(terms, block))
        want = {}
        for t in terms:
            for k, x in zip(index.docs[t], index.impacts[t], strict=True):
                want[k] = want.get(k, 0.0) + x
        assert {k for k, x in want.items() if x >= 1 - 1e-12} <= set(got) <= {k for k, x in want.items() if x >= 1 - 1e-6}


def test_bounds_lose_no_passage():
    index = d.Index(ITEMS)
    for _ in range(100):
        words = [RNG.choice(VOCAB) for _ in range(RNG.randrange(300))]
        at = RNG.randrange(len(words) + 1)
        words[at:at] = RNG.choice(ITEMS)[1].split()
        text = " ".join(words)
        assert set(index.matches(text)) == brute_matches(text, ITEMS)


def brute_matches(text, items):
    words = d.WORDS.findall(text.lower())
    out = set()
    for i, t in items:
        w = d.WORDS.findall(t.lower())
        half = (len(w) + 1) // 2
        ok = bool(w)
        for part, least in ((w, 0.8), (w[:half], 0.5), (w[half:] or w, 0.5)):
            want = d.shingles(part)
            n = len(next(iter(want))) if want else 0
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            ok &= bool(want) and len(want & have) / len(want) >= least
        if ok:
            out.add(i)
    return out


def test_documents_against_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 50)
    items = spark.createDataFrame([*ITEMS, (500, None), (501, ""), (502, ITEMS[0][1])], "item_id long, text string")
    rows = [(None, ITEMS[3][1]), (0, None), (1, "")]
    for i in range(2, 80):
        noise = [RNG.choice(VOCAB) for _ in range(RNG.randrange(400))]
        planted = RNG.choice(ITEMS)[1].split()
        if i % 3:
            at = RNG.randrange(len(noise) + 1)
            if i % 5 == 0:  # an edit in the middle
                planted[len(planted) // 2] = "edited"
            noise[at:at] = planted
        rows.append((i, " ".join(noise).upper() + "."))
    docs = make_docs(rows)
    got = {r.doc_id: r for r in d.decontaminate(docs, items).collect()}
    for i, t in rows:
        want = brute_matches(t or "", [*ITEMS, (502, ITEMS[0][1])])
        assert got[i].items == ",".join(map(str, sorted(want))) and got[i].contaminated == bool(want) and got[i].n_items == len(want)
    assert d.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert d.decontaminate(make_docs([]), items).count() == 0


def test_odd(spark, odd_docs):
    items = spark.createDataFrame([(1, "word5 thing5 word6 thing6 word7 thing7 word8 thing8")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_items) for r in d.decontaminate(odd_docs, items).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0), (4, 1), (5, 0), (6, 0), (7, 1)]


def test_insertions_at_all_offsets():
    item = [f"t{i}" for i in range(40)]
    index = d.Index([(7, " ".join(item)), *((100 + i, " ".join(f"z{i}a{k}" for k in range(40))) for i in range(20))])
    for inserted in (1, 24, 500):
        for before in range(0, 85):
            words = [f"b{i}" for i in range(before)] + item[:20] + [f"i{k}" for k in range(inserted)] + item[20:]
            assert set(index.matches(" ".join(words))) == {7} == brute_matches(" ".join(words), [(7, " ".join(item))])


def test_items_of_a_shared_template():
    items = [(i, " ".join(f"s{k}" for k in range(100)) + f" rare{i}") for i in range(300)]
    text = items[0][1].rsplit(" ", 1)[0]
    assert set(d.Index(items).matches(text)) == brute_matches(text, items) == set(range(300))
