"""Saved models with their offsets, and which one is served.

An artifact is a folder: MLlib models, the features' terms, and `meta.json`.
Its offsets stand beside it, in a file whose name follows from the folder's.
"""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from tessera.functions import decision
from tessera.plans.training import Classifier, Features, NoProbability, OffsetsMismatch, _of_model


class NotTrained(RuntimeError):
    """There is no model that can be served."""


@dataclass
class Artifact:
    classifier: Classifier
    features: Features
    offsets: dict[str, float] | None
    path: str


def offsets_path(path: str) -> str:
    """`.../model_x` has its offsets in `.../thresholds_x.json`."""
    folder, name = os.path.split(path.rstrip("/"))
    return os.path.join(folder, name.replace("model", "thresholds") + ".json")


def save(path: str, model, family: str, classes: list[str], features: Features, offsets: dict[str, float] | None = None) -> None:
    """Write an MLlib model, what its features need, and its offsets."""
    model.write().overwrite().save(f"{path}/model")
    features.terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    meta = {"family": family, "classes": classes, "greatest": features.greatest, "weight": features.weight, "size": features.size}
    with open(f"{path}/meta.json", "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=2)
    if offsets is not None:
        with open(offsets_path(path), "w", encoding="utf-8") as f:
            json.dump({"offsets": offsets}, f, indent=2)


def load_offsets(path: str) -> dict[str, float] | None:
    """The offsets of a file; None where there is none or it names none."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        raw = json.load(f).get("offsets")
    return {str(k): float(v) for k, v in raw.items()} if raw else None


def load(spark: SparkSession, path: str) -> Artifact:
    """An artifact, whose offsets have to fit its classes."""
    with open(f"{path}/meta.json", encoding="utf-8") as f:
        meta = json.load(f)
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    features = Features(spark.read.parquet(f"{path}/terms"), meta["greatest"], meta["weight"], meta["size"])
    offsets = load_offsets(offsets_path(path))
    if strange := decision.unknown_offsets(offsets or {}, meta["classes"]):
        raise OffsetsMismatch(f"{offsets_path(path)} has offsets of unknown classes: {strange}")
    return Artifact(_of_model(meta["family"], meta["classes"], model), features, offsets, path)


def served(spark: SparkSession, paths: list[str]) -> Artifact:
    """The first artifact that is there and gives probabilities; one that doesn't is passed by with a warning."""
    reason = "no model at " + ", ".join(paths)
    for path in paths:
        if not os.path.exists(f"{path}/meta.json"):
            continue
        found = load(spark, path)
        if found.classifier._scored is not None:
            return found
        reason = f"{path} can't be served: {found.classifier.family} gives no class probabilities"
        warnings.warn(reason, RuntimeWarning, stacklevel=2)
    raise NotTrained(reason)


def info(artifact: Artifact) -> dict:
    """Which model and which rule are live."""
    rule = "argmax_c(log P(c) - offset[c])" if artifact.offsets else "argmax_c(P(c))"
    return {"path": artifact.path, "family": artifact.classifier.family, "classes": artifact.classifier.classes, "rule": rule, "offsets": artifact.offsets}


def baseline(path: str, default: dict[str, float]) -> dict[str, float]:
    """Figures of an earlier run, from a file if it is there and reads as JSON, else constants."""
    try:
        with open(path, encoding="utf-8") as f:
            return {**default, **{k: v for k, v in json.load(f).items() if k in default}}
    except (FileNotFoundError, ValueError):
        return dict(default)


def write_report(payload: dict, path: str, sampled: bool = False, limited: bool = False) -> str | None:
    """Write a nested result as one JSON file; a sampled run goes beside the canonical file, a limited one nowhere."""
    if limited:
        return None
    root, ext = os.path.splitext(path)
    to = f"{root}_sampled{ext}" if sampled else path
    with open(to, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=True)
    return to


__all__ = ["Artifact", "NoProbability", "NotTrained", "baseline", "info", "load", "load_offsets", "offsets_path", "save", "served", "write_report"]
