"""Command line: scan a file, standard input or a literal; exit code 1 for findings, 0 for none, 2 without a model."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import decision, taxonomy
from tessera.operators import findings as N
from tessera.operators import rules as X
from tessera.sources import artifacts
from tessera.sources.corpus import whole_texts


def scanned(spark: SparkSession, texts, artifact: artifacts.Artifact | None, threshold: float = decision.THRESHOLD, use_rules: bool = True):
    """A scan result for each text (row_id, code): a classifier's classes over the threshold and the rules' findings, merged; without an artifact by rules alone."""
    if artifact is None:
        ranked = texts.select("row_id", F.array(F.struct(F.lit(taxonomy.SAFE).alias("label"), F.lit(1.0).alias("p"))).alias("ranking"))
    else:
        scored = artifact.classifier.predicted(artifact.features.vectors(texts), artifact.offsets)
        ranked = scored.select("row_id", decision.ranked(F.col("probs"), artifact.classifier.classes).alias("ranking"))
    ml = ranked.select("row_id", F.inline("ranking")).where((F.col("label") != taxonomy.SAFE) & (F.col("p") >= threshold)).select("row_id", F.col("label").alias("cwe"), F.round("p", 3).alias("confidence"))
    found = X.scan_table(texts if use_rules else texts.where("false"), "row_id", "code")
    return N.scan_results(N.merge_detectors(ml, found, "row_id"), ranked, "row_id")


def shown(name: str, result: dict) -> str:
    """A result as text."""
    if not result["is_vulnerable"]:
        return f"[OK] {name}: no known vulnerability detected (top: {result['top_prediction']} {result['top_confidence']:.0%})"
    lines = [f"[!] {name}: {len(result['findings'])} potential vulnerability(ies):"]
    for f in result["findings"]:
        title, owasp, about = taxonomy.CLASSES[f["cwe"]]
        lines += [f"  - {f['cwe']}  {title}  ({f['confidence']:.0%} confidence)", f"      OWASP {owasp} — {about}"]
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description="Scan a code text for known defects.")
    p.add_argument("target", nargs="?", help="a file, or - for standard input")
    p.add_argument("--code", help="scan this text")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--threshold", type=float, default=decision.THRESHOLD)
    p.add_argument("--model", action="append", help="folder of a model; the first that can be served is taken")
    p.add_argument("--rules-only", action="store_true", help="don't ask for a model")
    args = p.parse_args(argv)
    if args.target is None and args.code is None:
        p.error("give a file, - or --code")
    spark = spark or SparkSession.builder.master("local[2]").appName("tessera").getOrCreate()
    name = "<--code>" if args.code is not None else "<stdin>" if args.target == "-" else args.target
    if args.code is None and args.target != "-":
        texts = whole_texts(spark, args.target).select(F.lit(0).alias("row_id"), F.col("text").alias("code"))
    else:
        text = args.code if args.code is not None else sys.stdin.read()
        texts = spark.createDataFrame([(0, text)], "row_id int, code string")
    try:
        artifact = None if args.rules_only else artifacts.served(spark, args.model or [])
    except artifacts.NotTrained as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    result = scanned(spark, texts, artifact, args.threshold).first().asDict(recursive=True)
    result.pop("row_id")
    print(json.dumps(result, indent=2) if args.json else shown(name, result))
    return int(result["is_vulnerable"])


if __name__ == "__main__":
    sys.exit(main())
