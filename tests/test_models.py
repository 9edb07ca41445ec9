import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.sql import functions as F

from tessera import cli, settings
from tessera.functions.tfidf import char_grams, word_grams
from tessera.plans import training as T
from tessera.plans import tuning
from tessera.sources import artifacts as A

WORDS = {"safe": "return value add sum list".split(), "CWE-89": "select query execute cursor where".split(), "CWE-79": "html script inner document write".split()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(90):
        label = list(WORDS)[i % 3]
        made.append((i, " ".join(rng.choice(WORDS[label] if rng.random() < 0.8 else WORDS["safe"]) for _ in range(12)) + (" eval(x);" if label == "CWE-79" else ""), label))
    return spark.createDataFrame(made, "row_id int, code string, label string").persist()


@pytest.fixture(scope="module")
def fitted(rows):
    made = T.fit_features(rows, max_terms=300, min_df=3)
    return made, made.vectors(rows).persist()


def test_vectors_equal_brute_force(spark, rows, fitted):
    made, vectors = fitted
    terms = {(r.block, r.term): (r.idf, r.i) for r in made.terms.collect()}
    assert made.size == len(terms) + 45 and sorted(i for _, i in terms.values()) == list(range(len(terms)))
    grams = {r.row_id: (r.w, r.c) for r in rows.select("row_id", word_grams(F.col("code")).alias("w"), char_grams(F.col("code")).alias("c")).collect()}
    for r in vectors.limit(10).collect():
        want = np.zeros(made.size)
        for block, tokens in zip(("word", "char"), grams[r.row_id], strict=True):
            got = {t: (1 + math.log(tokens.count(t))) * terms[block, t][0] for t in set(tokens) if (block, t) in terms}
            norm = math.sqrt(sum(x * x for x in got.values()))
            for t, x in got.items():
                want[terms[block, t][1]] = x / norm
        have = r.features.toArray()
        assert np.allclose(have[: len(terms)], want[: len(terms)]) and (np.abs(have[len(terms) :]) <= 1 + 1e-12).all()


@pytest.mark.parametrize(("fit", "params"), [(T.logistic, {"c": 4.0, "iterations": 50}), (T.complement_bayes, {"smoothing": 0.5}), (T.linear_svm, {"c": 1.0, "folds": 2, "iterations": 20}), (T.forest, {"trees": 10})])
def test_candidates(rows, fitted, fit, params):
    _, vectors = fitted
    classes = sorted(WORDS)
    train, test = vectors.where("row_id < 60"), vectors.where("row_id >= 60")
    made = fit(train, classes, **params)
    out = made.predicted(test)
    probs = [r.probs for r in out.select("probs").collect()]
    assert len(probs) == 30 and all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p in probs)
    report, summary = T.evaluate(made, test)
    assert summary.first().macro_f1 > 0.7 and {r.label for r in report.collect()} <= set(classes)
    with pytest.raises(T.OffsetsMismatch):
        made.predicted(test, {"CWE-1": 1.0})


def test_complement_bayes_equals_its_formula(spark, fitted):
    _, vectors = fitted
    classes = sorted(WORDS)
    data = [(r.features.toArray(), classes.index(r.label)) for r in vectors.orderBy("row_id").collect()]
    x, y = np.array([f for f, _ in data]), np.array([k for _, k in data])
    weights = []
    for k in range(3):
        other = x[y != k].sum(0) + 1.0
        weights.append(-np.log(other / other.sum()))
    want = (x @ np.array(weights).T).argmax(1)
    made = T.complement_bayes(vectors, classes, 1.0)
    got = [classes.index(r.predicted) for r in made.predicted(vectors).orderBy("row_id").select("predicted").collect()]
    assert np.mean(np.array(got) == want) > 0.95


def test_bake_off_takes_the_first_best_and_notes_failures(fitted):
    _, vectors = fitted

    def broken(train, classes, label="label"):
        raise RuntimeError("no")

    classes = sorted(WORDS)
    best, results = T.bake_off(vectors, vectors, classes, [("broken", {}, broken), ("a", {"smoothing": 0.1}, T.complement_bayes), ("b", {"smoothing": 0.1}, T.complement_bayes)])
    assert [r["seq"] for r in results] == [0, 1, 2] and "RuntimeError" in results[0]["error"] and results[1]["macro_f1"] == results[2]["macro_f1"] and best is not None
    assert len(T.grid()) == 9
    tuned, info = tuning.tune_offsets(T.log_scores(best, vectors), 3, tuning.offset_grid(1.0, 0.5), 1)
    assert len(tuned) == 3 and info["tuned"] >= info["argmax"]


def test_margins_alone_are_refused(fitted):
    _, vectors = fitted
    model = LinearSVC(labelCol="_y", maxIter=5).fit(vectors.withColumn("_y", (F.col("label") == "safe").cast("double")))
    with pytest.raises(T.NoProbability):
        T._of_model("svm", ["a", "safe"], model).scored(vectors)


def test_artifacts_and_command_line(spark, rows, fitted, tmp_path, capsys):
    made, vectors = fitted
    classes = sorted(WORDS)
    y = T._indexed(vectors, classes, "label")
    good, bad = str(tmp_path / "model_b"), str(tmp_path / "model_a")
    A.save(good, NaiveBayes(labelCol="_y", modelType="complement").fit(y), "complement_bayes", classes, made, {"safe": 0.5})
    A.save(bad, LinearSVC(labelCol="_y", maxIter=5).fit(y.where("_y < 2")), "svm", classes, made)
    assert A.offsets_path(good).endswith("thresholds_b.json")
    with pytest.warns(RuntimeWarning):
        found = A.served(spark, [str(tmp_path / "absent"), bad, good])
    assert found.path == good and found.offsets == {"safe": 0.5} and A.info(found)["rule"].startswith("argmax_c(log")
    again = found.classifier.predicted(found.features.vectors(rows), found.offsets)
    assert again.count() == 90
    with open(A.offsets_path(good), "w") as f:
        json.dump({"offsets": {"CWE-1": 1.0}}, f)
    with pytest.raises(T.OffsetsMismatch):
        A.load(spark, good)
    os.remove(A.offsets_path(good))
    assert A.load(spark, good).offsets is None
    with pytest.raises(A.NotTrained):
        A.served(spark, [])

    code = tmp_path / "a.js"
    code.write_bytes(b"var q = f(); // \xff\nel.innerHTML = q;")
    assert cli.main([str(code), "--rules-only"], spark) == 1
    assert "CWE-79" in capsys.readouterr().out
    assert cli.main(["--code", "int a;", "--rules-only", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["findings"] == []
    assert cli.main(["--code", "x"], spark) == 2 and "error" in capsys.readouterr().err
    assert cli.main(["--code", " ".join(WORDS["CWE-89"] * 4), "--model", good, "--threshold", "0.3"], spark) in (0, 1)
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_reports_and_baselines(tmp_path):
    path = str(tmp_path / "metrics.json")
    assert A.write_report({"a": 1}, path, limited=True) is None and not os.path.exists(path)
    assert A.write_report({"a": 1}, path, sampled=True).endswith("metrics_sampled.json") and not os.path.exists(path)
    assert A.write_report({"a": 1}, path) == path and A.baseline(path, {"a": 0, "b": 2}) == {"a": 1, "b": 2}
    assert A.baseline(str(tmp_path / "none"), {"a": 0}) == {"a": 0}


def test_options_and_settings(monkeypatch):
    assert settings.tuning_options(["--sample", "10"]).sample == 10
    for bad in (["--final", "--sample", "5"], ["--offset-step", "9", "--offset-max", "1"], ["--weak-classes", "safe"], ["--weak-classes", "CWE-1"]):
        with pytest.raises(SystemExit):
            settings.tuning_options(bad)
    monkeypatch.setenv("LOG_LEVEL", "DEBUG")
    settings.settings.cache_clear()
    assert settings.settings().log_level == "DEBUG" and settings.settings() is settings.settings()
    settings.settings.cache_clear()
