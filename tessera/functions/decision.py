"""The shared decision rule on class probabilities, as expressions on maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least probability, the score of an absent class, the usual threshold.
LEAST, ABSENT, THRESHOLD = 1e-12, -1e9, 0.5


def aligned(scores: Column, classes: list[str], absent: float = ABSENT) -> Column:
    """A map of scores as an array in the classes' order."""
    return F.array(*[F.coalesce(F.try_element_at(scores, F.lit(c)), F.lit(float(absent))) for c in classes])


def unknown_offsets(offsets: dict[str, float], classes: list[str]) -> list[str]:
    """Offsets of no class; there must be none."""
    return sorted(set(offsets) - set(classes))


def with_offsets(probs: Column, classes: list[str], offsets: dict[str, float]) -> Column:
    """Probabilities (an array in the classes' order) after the offsets are taken off their logarithms; as they are if all offsets are zero."""
    if strange := unknown_offsets(offsets, classes):
        raise ValueError(f"offsets of unknown classes: {strange}")
    shifts = [float(offsets.get(c, 0.0)) for c in classes]
    if not any(shifts):
        return probs
    logs = F.zip_with(probs, F.array(*map(F.lit, shifts)), lambda p, o: F.log(F.least(F.greatest(p, F.lit(LEAST)), F.lit(1.0))) - o)

    def normal(z: Column) -> Column:
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return F.get(F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))), F.lit(0))

    return F.get(F.transform(F.array(logs), normal), F.lit(0))


def decide(probs: Column, classes: list[str]) -> Column:
    """The first class of the greatest probability."""
    return F.get(F.array(*map(F.lit, classes)), F.array_position(probs, F.array_max(probs)).cast("int") - 1)


def ranked(probs: Column, classes: list[str]) -> Column:
    """(label, p) by falling probability; ties keep the classes' order."""
    rows = F.zip_with(F.array(*map(F.lit, classes)), probs, lambda c, p: F.struct(c.alias("label"), p.alias("p")))
    keyed = F.transform(rows, lambda x, i: F.struct((-x["p"]).alias("k"), i.alias("i"), x["label"].alias("label"), x["p"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))


def named(ranking: Column, threshold: float = THRESHOLD) -> Column:
    """Classes, other than safe, at the threshold or above, sorted."""
    return F.array_sort(F.transform(F.filter(ranking, lambda x: (x["label"] != "safe") & (x["p"] >= threshold)), lambda x: x["label"]))
