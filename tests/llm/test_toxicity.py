import itertools

from tessera.llm import toxicity


def distance(a, b):
    """Edits with swaps of neighbours, each letter touched once."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_distances():
    import random

    rng = random.Random(3)
    terms = {"abcde": 1.0, "abba": 1.0, "cabbagecab": 1.0, "deedab": 1.0}
    automaton = toxicity.LexiconAutomaton(terms, {"ceca": 1.0})
    for _ in range(3000):
        base = rng.choice([*terms, "cecabb"])
        word = list(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "e"])
        word = "".join(word)
        want = max((toxicity.EDIT**e for t in terms if (e := distance(t, word)) <= toxicity.allowed(len(t))), default=0.0)
        if word.startswith("ceca"):
            want = 1.0
        assert toxicity.LexiconAutomaton.match(automaton, word) == want, word


def own(i):
    """Words of a text's own, as copies count once."""
    return " ".join(f"w{(i * 7919 + k * 104729) % 99991}" for k in range(8))


ROWS = [(f"you are a fan of {w} and talk indeed {own(i)}", 0) for i, w in enumerate(["rivers", "trains", "music", "bread"] * 30)] + [(f"you are a {w} and {x} indeed {own(1000 + i)}", 1) for i, (w, x) in enumerate([("moron", "loser"), ("loser", "idiot"), ("idiot", "moron")] * 10)]


def test_learn_and_context():
    s = toxicity.learn(ROWS)
    assert {"moron", "loser", "idiot"} <= set(s.terms) | {w for w in ("moron", "loser", "idiot") if s.weight(w)}
    assert s.score("what a m0ron") > 0.5 > s.score("a walk by the rivers") and s.score("") < 0.5
    assert s.score("you idoit moron") > 0.5
    quoted = s.hits('he said the word "moron" was rude')
    assert quoted and quoted[0] < s.hits("that moron was rude")[0] < s.hits("you moron that was rude")[0]


def test_tables(spark, odd_docs, make_docs):
    docs = make_docs([*enumerate(t for t, _ in ROWS), (900, None), (901, "")])
    labels = spark.createDataFrame([*((i, y) for i, (_, y) in enumerate(ROWS)), (0, 0), (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    scorer = toxicity.train(docs, labels)
    rows = toxicity.score(docs, scorer).collect()
    assert all((r.score >= 0.5) == bool(ROWS[r.doc_id][1]) for r in rows if r.doc_id < 900) and len(rows) == len(ROWS) + 2
    assert toxicity.score(odd_docs, scorer).count() == 9
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.6 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(make_docs([]), none).count() == 0


def test_repeated_rows_push_out_no_others(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 20)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 20)
    monkeypatch.setattr(toxicity, "learn", lambda rows: rows)
    ids = range(1, 31)
    docs = make_docs([(i, f"text {i}") for i in ids for _ in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    want = [i for (i,) in labels.where(~toxicity.held_out("doc_id")).select("doc_id").collect()]
    assert sorted(toxicity.train(docs, labels)) == sorted((f"text {i}", i % 2) for i in want)


def test_texts_of_a_batch_are_taken_in_slices():
    import pyarrow as pa
    from pyspark.sql import types as T

    class Docs:
        columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    texts = ["badword " + "x" * (3 << 20), None, "y" * (3 << 20), "badword"]
    scorer = toxicity.Scorer({"badword": 1.0}, {}, [], [-3.0, 6.0])
    out = list(toxicity.score(Docs(), scorer)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert len(out) == 2 and [x for b in out for x in b.column("score").to_pylist()] == [scorer.score(t or "") for t in texts]
    assert [x for b in out for x in b.column("text").to_pylist()] == texts
