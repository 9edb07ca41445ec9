"""Fitting, choosing and serving classifiers of code texts, with MLlib.

Features are three blocks side by side: word and character TF-IDF, and the
45 security features scaled by their greatest absolute value in training.
Every candidate gives class probabilities, those that only have margins by
one-dimensional logistic calibration on folds they weren't fitted on. All
probabilities are arrays in the order of the sorted classes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import decision, tfidf
from tessera.functions.security_features import cut, features
from tessera.operators import metrics as M

# Terms of a block, folds of the calibration, candidates.
MAX_TERMS, MIN_DF, FOLDS = 20_000, 3, 3
LOGISTIC_C, SVM_C, SMOOTHING = (1.0, 4.0), (0.5, 1.0, 2.0), (0.1, 0.5, 1.0)


class NoProbability(TypeError):
    """A model that gives no class probabilities can't be served."""


class OffsetsMismatch(ValueError):
    """Offsets of classes that the model doesn't have."""


@dataclass
class Features:
    """What turns texts into vectors: a table (block, term, idf, i) of bounded size, the security block's greatest values, and its weight."""

    terms: DataFrame
    greatest: list[float]
    weight: float
    size: int

    def vectors(self, rows: DataFrame, id_col: str = "row_id", code: str = "code") -> DataFrame:
        """All columns of `rows`, and features."""
        texts = rows.select(F.col(id_col), cut(F.col(code)).alias("t"))
        parts = [tfidf.weighed(tfidf.counted(texts, id_col, grams), self.terms.where(F.col("block") == name).drop("block"), id_col) for name, grams in BLOCKS(F.col("t"))]
        placed = parts[0].unionByName(parts[1]).select(id_col, F.struct("i", "weight").alias("x"))
        sparse = placed.groupBy(id_col).agg(F.array_sort(F.collect_list("x")).alias("x"))
        at = self.size - len(self.greatest)
        scaled = F.array(*[F.lit(0.0) if g == 0 else c * (self.weight / g) for c, g in zip(features(F.col("t")).values(), self.greatest, strict=True)])
        dense = F.filter(F.transform(scaled, lambda v, i: F.struct((i + at).cast("int").alias("i"), v.alias("weight"))), lambda x: x["weight"] != 0)
        both = texts.select(id_col, dense.alias("d")).join(sparse, id_col, "left")
        entries = F.concat(F.coalesce("x", F.array().cast("array<struct<i:int,weight:double>>")), "d")
        size = self.size

        @F.udf(VectorUDT())
        def vector(i: list[int], w: list[float]) -> SparseVector:
            return SparseVector(size, i, w)

        made = both.select(id_col, vector(F.transform(entries, lambda x: x["i"]), F.transform(entries, lambda x: x["weight"])).alias("features"))
        return rows.join(made, id_col)


def BLOCKS(t: Column) -> list[tuple[str, Column]]:  # noqa: N802
    return [("word", tfidf.word_grams(t)), ("char", tfidf.char_grams(t))]


def fit_features(train: DataFrame, id_col: str = "row_id", code: str = "code", max_terms: int = MAX_TERMS, min_df: int = MIN_DF, weight: float = 1.0) -> Features:
    """Terms and scales of the training rows only."""
    spark = train.sparkSession
    texts = train.select(F.col(id_col), cut(F.col(code)).alias("t"))
    n = texts.agg(F.count("*").alias("n"))
    rows, at = [], 0
    for name, grams in BLOCKS(F.col("t")):
        # max_terms rows
        for term, idf in sorted(tfidf.fit_terms(tfidf.counted(texts, id_col, grams), n, min_df, max_terms).collect()):
            rows.append((name, term, idf, at))
            at += 1
    greatest = texts.agg(*[F.max(F.abs(c)).alias(k) for k, c in features(F.col("t")).items()]).first()
    kept = [float(x or 0.0) for x in greatest]
    return Features(spark.createDataFrame(rows, "block string, term string, idf double, i int"), kept, weight, at + len(kept))


class Classifier:
    """A fitted candidate; `scored` adds probs, an array in the classes' order."""

    def __init__(self, family: str, classes: list[str], scored: Callable[[DataFrame], DataFrame] | None):
        self.family, self.classes, self._scored = family, classes, scored

    def scored(self, rows: DataFrame) -> DataFrame:
        if self._scored is None:
            raise NoProbability(f"{self.family} gives no class probabilities; calibrate it where it is fitted")
        return self._scored(rows)

    def predicted(self, rows: DataFrame, offsets: dict[str, float] | None = None) -> DataFrame:
        """Adds probs, after the offsets, and predicted."""
        if strange := decision.unknown_offsets(offsets or {}, self.classes):
            raise OffsetsMismatch(f"offsets of unknown classes: {strange}")
        q = decision.with_offsets(F.col("probs"), self.classes, offsets or {})
        return self.scored(rows).withColumn("probs", q).withColumn("predicted", decision.decide(F.col("probs"), self.classes))


def _indexed(rows: DataFrame, classes: list[str], label: str) -> DataFrame:
    return rows.withColumn("_y", (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double"))


def _of_model(family: str, classes: list[str], model) -> Classifier:
    def scored(rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("probs", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction", "_y")

    return Classifier(family, classes, scored if hasattr(model, "getProbabilityCol") else None)


def logistic(train: DataFrame, classes: list[str], c: float = 1.0, label: str = "label", iterations: int = 200) -> Classifier:
    """Multinomial logistic regression; the penalty is 1 / (c * rows), as MLlib takes the mean of the losses."""
    n = max(train.count(), 1)
    model = LogisticRegression(labelCol="_y", family="multinomial", regParam=1.0 / (c * n), standardization=False, maxIter=iterations).fit(_indexed(train, classes, label))
    return _of_model("logistic", classes, model)


def complement_bayes(train: DataFrame, classes: list[str], smoothing: float = 1.0, label: str = "label") -> Classifier:
    """Complement naive Bayes on the non-negative features."""
    return _of_model("complement_bayes", classes, NaiveBayes(labelCol="_y", modelType="complement", smoothing=smoothing).fit(_indexed(train, classes, label)))


def forest(train: DataFrame, classes: list[str], trees: int = 100, label: str = "label", seed: int = 42) -> Classifier:
    """Random forest: what stands in for boosted trees with several classes."""
    return _of_model("forest", classes, RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=12, seed=seed).fit(_indexed(train, classes, label)))


def linear_svm(train: DataFrame, classes: list[str], c: float = 1.0, label: str = "label", folds: int = FOLDS, id_col: str = "row_id", iterations: int = 100) -> Classifier:
    """One linear support vector machine against the rest for each class and fold, calibrated on the fold's margins; probabilities are the folds' means, scaled to one."""
    usable = M.calibration_folds(train, folds, label).first()[0]
    if usable is None:
        raise ValueError("the rarest class has too few rows to calibrate on")
    # the rank by a hash within the class makes every fold have every class
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(id_col), id_col))
    rows = train.withColumn("_fold", F.pmod(rank, F.lit(int(usable)))).persist()
    fitted = []
    for f in range(int(usable)):
        inside, outside = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
        n = max(inside.count(), 1)
        for name in classes:
            one = lambda df: df.withColumn("_y", (F.col(label) == name).cast("double"))  # noqa: B023, E731
            svm = LinearSVC(labelCol="_y", regParam=1.0 / (c * n), standardization=False, maxIter=iterations).fit(one(inside))
            margins = one(svm.transform(outside)).select("_y", array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), F.lit(1)))).alias("features"))
            platt = LogisticRegression(labelCol="_y", standardization=False, maxIter=100).fit(margins)
            fitted.append((name, svm, float(platt.coefficients[0]), float(platt.intercept)))
    rows.unpersist()

    def scored(df: DataFrame) -> DataFrame:
        sums = {name: F.lit(0.0) for name in classes}
        keep = df.columns
        for k, (name, svm, slope, base) in enumerate(fitted):
            df = svm.setRawPredictionCol(f"_m{k}").setPredictionCol(f"_p{k}").transform(df)
            margin = F.get(vector_to_array(f"_m{k}"), F.lit(1))
            sums[name] = sums[name] + 1 / (1 + F.exp(-(margin * slope + base)))
        raw = F.array(*[sums[name] for name in classes])
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return df.select(*keep, F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(classes))).alias("probs"))

    return Classifier("linear_svm", classes, scored)


def grid() -> list[tuple[str, dict, Callable]]:
    """(family, parameters, fit) of every candidate, in order."""
    return [
        *[("linear_svm", {"c": c}, linear_svm) for c in SVM_C],
        *[("logistic", {"c": c}, logistic) for c in LOGISTIC_C],
        *[("complement_bayes", {"smoothing": a}, complement_bayes) for a in SMOOTHING],
        ("forest", {}, forest),
    ]


def evaluate(classifier: Classifier, rows: DataFrame, offsets: dict[str, float] | None = None, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(report by class, summary over the model's classes) of the deployed rule."""
    report = M.report(M.confusion(classifier.predicted(rows, offsets), label, "predicted"))
    return report, M.summary(report, classifier.classes)


def bake_off(train: DataFrame, validation: DataFrame, classes: list[str], candidates: list[tuple[str, dict, Callable]] | None = None, label: str = "label") -> tuple[Classifier | None, list[dict]]:
    """The candidate of the best macro F1 on validation rows, the first of equals, and what each gave; one that fails is noted and passed by."""
    best, results = None, []
    for seq, (family, params, fit) in enumerate(grid() if candidates is None else candidates):
        row = {"seq": seq, "family": family, "params": params}
        try:
            made = fit(train, classes, label=label, **params)
            row["macro_f1"] = float(evaluate(made, validation, label=label)[1].first()["macro_f1"])
            if best is None or row["macro_f1"] > best[0]:
                best = (row["macro_f1"], made)
        except Exception as e:  # noqa: BLE001 - a candidate may fail for any reason
            row["error"] = f"{type(e).__name__}: {e}"
        results.append(row)
    return (best and best[1]), results


def log_scores(classifier: Classifier, rows: DataFrame, label: str = "label") -> DataFrame:
    """(gold, scores) as tune_offsets wants them: class numbers and logarithms of probabilities."""
    scores = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(decision.LEAST))))
    return _indexed(classifier.scored(rows), classifier.classes, label).select(F.col("_y").cast("int").alias("gold"), scores.alias("scores"))
