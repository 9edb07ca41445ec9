"""Detector and classifier metrics, each in one pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import taxonomy


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 over nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def _binary(df, gold: Column, named: Column) -> DataFrame:
    vulnerable, flagged = gold != taxonomy.SAFE, F.size(named) > 0
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if(vulnerable).alias("n_vulnerable"),
        F.count_if(~vulnerable).alias("n_safe"),
        F.count_if(vulnerable & flagged).alias("tp"),
        F.count_if(~vulnerable & flagged).alias("fp"),
        F.count_if(vulnerable & ~flagged).alias("fn"),
        F.count_if(~vulnerable & ~flagged).alias("tn"),
    )
    flags = F.col("tp") + F.col("fp")
    return counts.withColumns(prf() | {"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")), "flag_rate": ratio(flags, F.col("n")), "fire_rate_on_safe": ratio(F.col("fp"), F.col("n_safe"))})


def binary_metrics(rows: DataFrame, gold: str = "gold", named: str = "named") -> DataFrame:
    """Flagged or not against vulnerable or not, over all rows; a row even for an empty table."""
    return _binary(rows, F.col(gold), F.col(named))


def by_groups(rows: DataFrame, keys: list[str], gold: str = "gold", named: str = "named") -> DataFrame:
    """The same for the whole and for each value of each key, by grouping sets: (grouping, value, metrics)."""
    cols = [F.col(k) for k in keys]
    grouped = rows.groupingSets([[], *[[c] for c in cols]], *cols)
    vulnerable, flagged = F.col(gold) != taxonomy.SAFE, F.size(named) > 0
    marks = [F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    out = grouped.agg(
        *marks,
        F.count("*").alias("n"),
        F.count_if(vulnerable & flagged).alias("tp"),
        F.count_if(~vulnerable & flagged).alias("fp"),
        F.count_if(vulnerable & ~flagged).alias("fn"),
        F.count_if(~vulnerable & ~flagged).alias("tn"),
    )
    which, value = F.lit("all"), F.lit("")
    for i, k in enumerate(keys):
        which, value = F.when(F.col(f"_g{i}") == 0, k).otherwise(which), F.when(F.col(f"_g{i}") == 0, F.col(k).cast("string")).otherwise(value)
    return out.withColumns(prf() | {"fire_rate_on_safe": ratio(F.col("fp"), F.col("fp") + F.col("tn"))}).select(which.alias("grouping"), value.alias("value"), "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fire_rate_on_safe")


def per_class(rows: DataFrame, gold: str = "gold", named: str = "named") -> DataFrame:
    """One against the rest for every class of the taxonomy and every other class named.

    Each row votes for its own class and for those it names, so no row meets
    a class that it has nothing to do with.
    """
    votes = rows.select(F.col(gold).alias("g"), F.explode(F.array_distinct(F.concat(F.array(F.col(gold)), F.col(named)))).alias("label"), F.col(named).alias("d"))
    hit = F.array_contains("d", F.col("label"))
    counts = votes.groupBy("label").agg(F.count_if(F.col("g") == F.col("label")).alias("support"), F.count_if((F.col("g") == F.col("label")) & hit).alias("tp"), F.count_if((F.col("g") != F.col("label")) & hit).alias("fp"), F.count_if((F.col("g") == F.col("label")) & ~hit).alias("fn"))
    listed = taxonomy.dimension(rows.sparkSession).select("label").withColumn("_in", F.lit(True))
    # classes of the gold labels come in by the taxonomy, others only if somebody names them
    out = listed.join(counts, "label", "full").where((F.col("label") != taxonomy.SAFE) & (F.col("_in") | (F.col("tp") + F.col("fp") > 0)))
    return out.select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "fp", "fn")]).withColumns(prf())


def macro_supported(classes: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 over the classes with support."""
    return classes.where("support > 0").agg(F.count("*").alias("n_classes"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def patched(pairs: DataFrame, gold: str = "gold", on_vuln: str = "on_vuln", on_fixed: str = "on_fixed") -> DataFrame:
    """What detectors say of the same code before and after its patch."""
    before, after, named = F.size(on_vuln) > 0, F.size(on_fixed) > 0, F.array_contains(on_vuln, F.col(gold))
    quiet = named & ~F.array_contains(on_fixed, F.col(gold))
    counts = pairs.agg(F.count("*").alias("pairs"), F.count_if(after).alias("fired_on_fixed"), F.count_if(after & ~before).alias("only_on_fixed"), F.count_if(named).alias("named_gold"), F.count_if(quiet).alias("went_silent"))
    return counts.withColumns({"fire_rate_on_fixed": ratio(F.col("fired_on_fixed"), F.col("pairs")), "patch_sensitivity": ratio(F.col("went_silent"), F.col("named_gold"))})


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """Per class of gold or prediction: tp, fp, fn, support, precision, recall, f1 - from the confusion matrix, which is classes by classes."""
    right = F.col("gold") == F.col("predicted")
    of_gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"))
    of_pred = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    both = of_gold.join(of_pred, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "called")])
    return both.select("label", "support", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn")).withColumns(prf())


def summary(classes: DataFrame, domain: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted means of a report; `domain` fixes the classes of the macro mean (absent ones count as 0), else those present."""
    total = F.sum("support")
    inside = F.lit(True) if domain is None else F.col("label").isin(*domain)
    k = F.count_if(inside) if domain is None else F.lit(len(domain))
    return classes.agg(
        total.alias("n"),
        ratio(F.sum("tp"), total).alias("accuracy"),
        *[ratio(F.sum(F.when(inside, F.col(c)).otherwise(0.0)), k).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def leak_rates(rows: DataFrame) -> DataFrame:
    """Share of held-out rows of each label that training has too."""
    return rows.where("split <> 'train'").groupBy("split", "label").agg(F.count("*").alias("n"), F.count_if("dup_of_train").alias("dup")).withColumn("rate", ratio(F.col("dup"), F.col("n")))


def first_best(candidates: DataFrame, score: str = "f1", seq: str = "seq") -> DataFrame:
    """The candidate of the greatest score, the first of equals, by one aggregate."""
    best = candidates.agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(seq)).alias("k"))).alias("b"))
    return candidates.join(F.broadcast(best), (F.col(score) == F.col("b.s")) & (F.col(seq) == -F.col("b.k"))).drop("b")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def coverage_loss(rows: DataFrame, predicted: str = "predicted") -> DataFrame:
    """What becomes of rows whose class a model no longer has: a row for each prediction, with the share that is flagged at all."""
    counts = rows.groupBy(F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("predicted") != taxonomy.SAFE, F.col("n")).otherwise(0)).alias("still_flagged"))
    # one row
    return counts.join(F.broadcast(total)).withColumn("fraction_still_flagged", F.round(ratio(F.col("still_flagged"), F.col("n_rows")), 4))


def calibration_folds(rows: DataFrame, requested: int = 3, label: str = "label") -> DataFrame:
    """The folds that the rarest class allows, at most `requested`; null below two."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.least(F.lit(requested).cast("long"), F.min("n")).alias("k"))
    return least.select(F.when(F.col("k") >= 2, F.col("k")).alias("folds"))


def memorisation_premium(rows: DataFrame, domain: list[str]) -> DataFrame:
    """Macro F1 over a fixed list of classes on all rows, on those that training doesn't have, and the difference."""
    one = lambda df, name: summary(report(confusion(df)), domain).select(F.col("n").alias(f"n_{name}"), F.col("macro_f1").alias(f"f1_{name}"))
    both = one(rows, "all").join(F.broadcast(one(rows.where(~F.col("dup_of_train")), "unseen")))
    return both.withColumn("premium", F.col("f1_all") - F.col("f1_unseen"))


def headline(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The figures to quote for a detector: rows (gold, named, dup_of_train) and patched pairs (gold, on_vuln, on_fixed); the patched ones are null without a pair."""
    whole = binary_metrics(rows).select(*[F.col(c).alias(f"binary_{c}") for c in ("precision", "recall", "f1")], F.col("fire_rate_on_safe").alias("fire_rate_on_safe_rows"))
    unseen = binary_metrics(rows.where(~F.coalesce("dup_of_train", F.lit(False)))).select(F.col("f1").alias("binary_f1_unseen_only"))
    macro = macro_supported(per_class(rows)).select(F.col("macro_f1").alias("cwe_macro_f1"))
    some = F.col("pairs") > 0
    fixed = patched(pairs).select(F.when(some, F.col("fire_rate_on_fixed")).alias("fire_rate_on_patched_code_upper_bound"), F.when(some, F.col("patch_sensitivity")).alias("patch_sensitivity"))
    # one row each
    return whole.join(F.broadcast(unseen)).join(F.broadcast(macro)).join(F.broadcast(fixed))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has, as often as it has them more; empty if they agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def top_class(rows: DataFrame, id_col: str, candidates: str = "scores") -> DataFrame:
    """The class of the greatest score (label, p, order in the list) by an aggregate over rows, the first of equals."""
    each = rows.select(id_col, F.posexplode(candidates).alias("i", "s"))
    best = each.groupBy(id_col).agg(F.max(F.struct(F.col("s.p").alias("p"), (-F.col("i")).alias("k"), F.col("s.label").alias("label"))).alias("b"))
    return best.select(id_col, F.col("b.label").alias("predicted"))
