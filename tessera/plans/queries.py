"""The engine's queries by name, over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import decision, taxonomy
from tessera.functions.security_features import security_features
from tessera.operators import corpus as C
from tessera.operators import findings as N
from tessera.operators import metrics as M
from tessera.operators import review as R
from tessera.operators import rules as X
from tessera.sources.corpus import code_corpus, table
from tessera.streaming import webhook

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASS_LIST = [taxonomy.SAFE, *taxonomy.CLASSES]
OFFSETS = {"safe": 0.25, "CWE-89": -0.5, "MEMORY-OOB": 0.1}

_CORPUS = """
WITH raw AS (SELECT doc_id AS row_id, CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
  text AS code, doc_id % 3 = 0 AS is_vulnerable, CASE WHEN doc_id % 7 = 0 THEN 'C++' ELSE lang END AS language, source,
  CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' ELSE 'fixed ' || text END AS code_fixed,
  CASE doc_id % 13 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-94' WHEN 3 THEN 'CWE-502' WHEN 4 THEN 'CWE-20' WHEN 5 THEN 'CWE-200'
    WHEN 6 THEN 'CWE-476' WHEN 7 THEN 'MEMORY-OOB' WHEN 8 THEN 'MEMORY-OOB' WHEN 9 THEN 'MEMORY-OOB' END AS folded FROM documents),
lab AS (SELECT * REPLACE (substr(coalesce(code, ''), 1, 4000) AS code), CASE WHEN is_vulnerable THEN folded ELSE 'safe' END AS label,
  md5(substr(coalesce(code, ''), 1, 4000)) AS code_hash FROM raw WHERE NOT is_vulnerable OR folded IS NOT NULL),
flag AS (SELECT *, CASE WHEN split <> 'train' THEN code_hash IN (SELECT code_hash FROM lab WHERE split = 'train') END AS dup_of_train FROM lab),
det AS (SELECT *, CASE row_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN CASE WHEN label = 'safe' THEN ['CWE-79'] ELSE [label] END
  WHEN 2 THEN ['CWE-1337', 'CWE-89'] ELSE ['CWE-79'] END AS named FROM flag)
"""
_PRF = """coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall,
  coalesce(2 * (coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0)) / nullif(coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0), 0), 0.0)::DOUBLE AS f1"""
_TALLY = """count(*) FILTER (label <> 'safe' AND len(named) > 0) AS tp, count(*) FILTER (label = 'safe' AND len(named) > 0) AS fp,
  count(*) FILTER (label <> 'safe' AND len(named) = 0) AS fn, count(*) FILTER (label = 'safe' AND len(named) = 0) AS tn"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled(code_corpus(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the sets that a detector names."""
    k, own = F.col("row_id") % 4, F.when(F.col("label") == "safe", F.array(F.lit("CWE-79"))).otherwise(F.array("label"))
    named = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, own).when(k == 2, F.array(F.lit("CWE-1337"), F.lit("CWE-89"))).otherwise(F.array(F.lit("CWE-79")))
    return C.flag_leaks(labelled(spark, sf_dir)).withColumns({"named": named, "gold": F.col("label"), "language_group": taxonomy.language_group(F.col("language"))})


@query(_CORPUS + f", g AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(lg) = 0 THEN 'language_group' ELSE 'all' END AS grouping, coalesce(source, language, lg, '') AS value, count(*) AS n, {_TALLY} FROM (SELECT *, CASE WHEN lower(trim(language)) IN ('c', 'c++', 'cpp') THEN 'c_family' ELSE 'non_c' END AS lg FROM det) GROUP BY GROUPING SETS ((), (source), (language), (lg))) SELECT *, {_PRF}, coalesce(fp / nullif(fp + tn, 0), 0.0)::DOUBLE AS fire_rate_on_safe FROM g")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector metrics for the whole and by source, language and language group, in one pass."""
    return M.by_groups(detections(spark, sf_dir), ["source", "language", "language_group"])


@query(_CORPUS + "SELECT row_id, split, label, code_hash, length(code) AS n_code FROM lab")
def labels_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded labels, cut codes and their hashes."""
    return labelled(spark, sf_dir).select("row_id", "split", "label", "code_hash", F.length("code").alias("n_code"))


@query(_CORPUS + "SELECT row_id, split, dup_of_train FROM flag")
def leak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which held-out rows training has too."""
    return C.flag_leaks(labelled(spark, sf_dir)).select("row_id", "split", "dup_of_train")


@query(_CORPUS + "SELECT row_id, split, label FROM lab WHERE split <> 'train' OR code_hash NOT IN (SELECT code_hash FROM lab WHERE split <> 'train')")
def leaks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without training rows that are held out too."""
    return C.drop_leaks(labelled(spark, sf_dir)).select("row_id", "split", "label")


@query(_CORPUS + "SELECT split, label, count(*) AS n FROM lab GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split and label."""
    return labelled(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(_CORPUS + "SELECT split, label, count(*) AS n, count(*) FILTER (dup_of_train) AS dup, (count(*) FILTER (dup_of_train)) / count(*)::DOUBLE AS rate FROM flag WHERE split <> 'train' GROUP BY ALL")
def leak_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of leaked rows by split and label."""
    return M.leak_rates(C.flag_leaks(labelled(spark, sf_dir)))


@query(_CORPUS + "SELECT code_hash, count(*) AS n_rows, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM lab GROUP BY code_hash HAVING count(DISTINCT label) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal codes with different labels."""
    return C.label_conflicts(labelled(spark, sf_dir))


@query(_CORPUS + ", c AS (SELECT count(*) FILTER (label <> 'safe') AS v, count(*) FILTER (label = 'safe') AS s FROM lab WHERE split = 'train') SELECT label, CASE WHEN label = 'safe' THEN least((SELECT s FROM c), greatest((SELECT CAST(round_even(v * 1.5, 0) AS BIGINT) FROM c), 20)) ELSE count(*) END AS n FROM lab WHERE split = 'train' GROUP BY label")
def safe_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label after safe ones are sampled to 1.5 times the others."""
    train = labelled(spark, sf_dir).where("split = 'train'")
    return C.downsample_safe(train, 1.5, 20).groupBy("label").agg(F.count("*").alias("n"))


@query(_CORPUS + ", c AS (SELECT label, count(*) AS n FROM lab GROUP BY label), t AS (SELECT sum(n) AS t FROM c) SELECT label, CASE WHEN 200 >= t THEN n ELSE least(n, greatest(1, CAST(round_even(n * 200.0 / t, 0) AS BIGINT))) END AS n FROM c, t")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label in a stratified sample of 200."""
    return C.stratified_sample(labelled(spark, sf_dir), 200).groupBy("label").agg(F.count("*").alias("n"))


@query(_CORPUS + f", t AS (SELECT count(*) AS n, count(*) FILTER (label <> 'safe') AS n_vulnerable, count(*) FILTER (label = 'safe') AS n_safe, {_TALLY} FROM det WHERE NOT dup_of_train) SELECT *, {_PRF}, (tp + tn) / n::DOUBLE AS accuracy, (tp + fp) / n::DOUBLE AS flag_rate, fp / n_safe::DOUBLE AS fire_rate_on_safe FROM t")
def binary_metrics_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector metrics on held-out rows that training doesn't have."""
    return M.binary_metrics(detections(spark, sf_dir).where(~F.col("dup_of_train")))


_CLASSES_SQL = ", l AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in taxonomy.CLASSES) + f"]) AS label UNION SELECT unnest(named) FROM det), t AS (SELECT l.label, count(*) FILTER (d.label = l.label) AS support, count(*) FILTER (d.label = l.label AND list_contains(named, l.label)) AS tp, count(*) FILTER (d.label <> l.label AND list_contains(named, l.label)) AS fp, count(*) FILTER (d.label = l.label AND NOT list_contains(named, l.label)) AS fn FROM l, det d GROUP BY l.label), p AS (SELECT *, {_PRF} FROM t) "


@query(_CORPUS + _CLASSES_SQL + "SELECT * FROM p")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One against the rest for each class, and classes that nobody knows."""
    return M.per_class(detections(spark, sf_dir))


@query(_CORPUS + _CLASSES_SQL + "SELECT count(*) AS n_classes, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM p WHERE support > 0")
def macro_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the classes with support."""
    return M.macro_supported(M.per_class(detections(spark, sf_dir)))


@query(_CORPUS + ", v AS (SELECT *, CASE WHEN row_id % 8 < 4 THEN []::VARCHAR[] ELSE named END AS after FROM det WHERE is_vulnerable AND trim(code_fixed) <> '' AND code_fixed <> code), t AS (SELECT count(*) AS pairs, count(*) FILTER (len(after) > 0) AS fired_on_fixed, count(*) FILTER (len(after) > 0 AND len(named) = 0) AS only_on_fixed, count(*) FILTER (list_contains(named, label)) AS named_gold, count(*) FILTER (list_contains(named, label) AND NOT list_contains(after, label)) AS went_silent FROM v) SELECT *, coalesce(fired_on_fixed / nullif(pairs, 0), 0.0)::DOUBLE AS fire_rate_on_fixed, coalesce(went_silent / nullif(named_gold, 0), 0.0)::DOUBLE AS patch_sensitivity FROM t")
def patched_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections before and after patches."""
    rows = detections(spark, sf_dir).where(taxonomy.has_patch(F.col("is_vulnerable"), F.col("code"), F.col("code_fixed")))
    after = F.when(F.col("row_id") % 8 < 4, F.array().cast("array<string>")).otherwise(F.col("named"))
    return M.patched(rows.select("gold", F.col("named").alias("on_vuln"), after.alias("on_fixed")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels and a prediction that is right for two rows of three, else the last of its detector's set."""
    rows = detections(spark, sf_dir)
    guess = F.when(F.col("row_id") % 3 != 2, F.col("label")).otherwise(F.coalesce(F.try_element_at("named", F.lit(-1)), F.lit("safe")))
    return rows.select("row_id", "gold", guess.alias("predicted"))


_PRED_SQL = ", pred AS (SELECT label AS gold, CASE WHEN row_id % 3 <> 2 THEN label ELSE coalesce(named[-1], 'safe') END AS predicted FROM det) "
_REPORT_SQL = _PRED_SQL + f", k AS (SELECT gold AS label FROM pred UNION SELECT predicted FROM pred), t AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM k, pred GROUP BY label), p AS (SELECT *, {_PRF} FROM t) "


@query(_CORPUS + _PRED_SQL + "SELECT gold, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by gold label and prediction."""
    return M.confusion(predictions(spark, sf_dir))


@query(_CORPUS + _REPORT_SQL + "SELECT * FROM p")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of every class."""
    return M.report(M.confusion(predictions(spark, sf_dir)))


@query(_CORPUS + _REPORT_SQL + ", d AS (SELECT * FROM p WHERE label IN (" + ", ".join(f"'{c}'" for c in CLASS_LIST) + f")) SELECT sum(support)::BIGINT AS n, sum(tp) / sum(support)::DOUBLE AS accuracy, (SELECT sum(precision) FROM d) / {len(CLASS_LIST)} AS macro_precision, (SELECT sum(recall) FROM d) / {len(CLASS_LIST)} AS macro_recall, (SELECT sum(f1) FROM d) / {len(CLASS_LIST)} AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM p")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro means over the fixed classes, weighted means."""
    return M.summary(M.report(M.confusion(predictions(spark, sf_dir))), CLASS_LIST)


_P_SQL = "[" + ", ".join(f"((doc_id * {i + 3} + {i}) % 17 + 1)::DOUBLE" for i in range(len(CLASS_LIST))) + "]"
_C_SQL = "[" + ", ".join(f"'{c}'" for c in CLASS_LIST) + "]"
_O_SQL = "[" + ", ".join(str(float(OFFSETS.get(c, 0.0))) for c in CLASS_LIST) + "]"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities derived from ids, in the classes' order."""
    raw = F.array(*[((F.col("doc_id") * (i + 3) + i) % 17 + 1).cast("double") for i in range(len(CLASS_LIST))])
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("probs", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, y: a + y)))


@query(f"WITH p AS (SELECT doc_id, {_P_SQL} AS w, {_C_SQL} AS c, {_O_SQL} AS o FROM documents), z AS (SELECT doc_id, c, list_transform(range(1, len(w) + 1), lambda i: ln(w[i] / list_sum(w)) - o[i]) AS z FROM p), e AS (SELECT doc_id, c, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z) SELECT doc_id, c[list_position(e, list_max(e))] AS predicted, round(list_max(e) / list_sum(e), 9) AS p FROM e")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions after class offsets; the first of equals wins."""
    rows = probabilities(spark, sf_dir).select("doc_id", decision.with_offsets(F.col("probs"), CLASS_LIST, OFFSETS).alias("q"))
    return rows.select("doc_id", decision.decide(F.col("q"), CLASS_LIST).alias("predicted"), F.round(F.array_max("q"), 9).alias("p"))


@query(f"WITH p AS (SELECT doc_id, unnest({_C_SQL}) AS label, unnest({_P_SQL}) AS w, list_sum({_P_SQL}) AS s, unnest(range({len(CLASS_LIST)})) AS i FROM documents) SELECT doc_id, string_agg(label, ',' ORDER BY w DESC, i) AS ranking, coalesce(string_agg(label, ',' ORDER BY label) FILTER (label <> 'safe' AND w / s >= 0.15), '') AS named FROM p GROUP BY doc_id")
def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes by falling probability, and those over a threshold."""
    rows = probabilities(spark, sf_dir).select("doc_id", decision.ranked(F.col("probs"), CLASS_LIST).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: x["label"]), ",").alias("ranking"), F.array_join(decision.named(F.col("r"), 0.15), ",").alias("named"))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, 'CWE-' || (l_partkey % 3) AS cwe, l_discount AS confidence, l_suppkey AS line, l_returnflag AS rule_id FROM lineitem),
m AS (SELECT o_orderkey AS doc_id, 'CWE-' || (o_custkey % 3) AS cwe, (o_orderkey % 10) / 100.0 AS confidence FROM orders),
g AS (SELECT doc_id, cwe, count(*) AS n, max(confidence) AS r, max({'s': seq, 'l': line, 'r': rule_id}) AS top FROM r GROUP BY ALL)
SELECT doc_id, cwe, CASE WHEN n IS NULL THEN 'ml' WHEN m.confidence IS NOT NULL OR n >= 2 THEN 'ml+rule' ELSE 'rule' END AS source,
  greatest(CAST(m.confidence AS DOUBLE), CAST(r AS DOUBLE)) AS confidence, top.l AS line, top.r AS rule_id FROM m FULL JOIN g USING (doc_id, cwe)""")
def detectors_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each document and class from two detectors (here lines and orders stand for their findings)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("CWE-"), F.col("l_partkey") % 3).alias("cwe"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_suppkey").alias("line"), F.col("l_returnflag").alias("rule_id"), F.lit("").alias("evidence"))
    ml = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("CWE-"), F.col("o_custkey") % 3).alias("cwe"), ((F.col("o_orderkey") % 10) / 100.0).alias("confidence"))
    return N.merge_detectors(ml, lines).drop("evidence")


@query("SELECT p_partkey AS seq, CAST(p_size AS DOUBLE) AS f1 FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def first_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of the greatest score, the first of equals."""
    return M.first_best(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").cast("double").alias("f1")))


@query()
def security_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 security features of every document."""
    return security_features(table(spark, sf_dir, "documents"), "doc_id", "text")


def _diffs(spark: SparkSession, sf_dir: str, odd: str = ".txt") -> DataFrame:
    """Each document as a diff of one file: odd lines are added, even ones are context; `odd` is the suffix of odd ids."""
    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise(" "), x)), "\n")
    path = F.concat(F.lit("src/f"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(odd))
    head = F.concat(F.lit("diff --git a/x b/x\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), (n / 2).cast("int"), F.lit(" +1,"), n, F.lit(" @@\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.concat(head, body).alias("diff"))


@query("SELECT doc_id AS diff_id, 'src/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS path, CAST(i AS INTEGER) AS line, i % 2 = 1 AS is_added, length(t) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new side of every diff, line by line."""
    return N.parse_diffs(_diffs(spark, sf_dir)).select("diff_id", "path", "line", "is_added", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id AS diff_id, 'src/f' || doc_id || '.py' AS path, length(text) AS n FROM documents WHERE doc_id % 2 = 0 AND length(text) <= 60000 AND trim(text) <> ''")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every diff that are worth scanning, put together again."""
    return N.new_sides(N.parse_diffs(_diffs(spark, sf_dir))).select("diff_id", "path", F.length("text").cast("long").alias("n"))


@query("""SELECT doc_id AS response_id, true AS ok, 's' || doc_id AS summary, CAST(0 AS INTEGER) AS seq, 'f.py' AS file,
  CAST(CASE doc_id % 4 WHEN 0 THEN 42 WHEN 1 THEN 10 END AS INTEGER) AS line, CASE doc_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' ELSE 'refactor' END AS category,
  CASE doc_id % 2 WHEN 0 THEN 'major' ELSE 'minor' END AS severity, 'm' AS message, '' AS suggestion FROM documents""")
def reviews_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as typed findings, with odd words and lines put right."""
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("doc_id") % n).cast("int"))
    raw = F.concat(F.lit('Here:\n```json\n{"summary": "s'), "doc_id", F.lit('", "findings": [{"file": "f.py", "line": '), pick(4, '"42"', '"10-14"', "0", '"abc"'), F.lit(', "category": "'), pick(3, "Error Handling", "vulnerability", "whatever"), F.lit('", "severity": "'), pick(2, "HIGH", "odd"), F.lit('", "message": "m"}]}\n```'))
    return R.parse_reviews(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), raw.alias("raw")))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 401 ELSE 200 END AS INTEGER) AS status,
  CASE WHEN event_id % 5 = 0 THEN 'rejected' WHEN event_id % 3 = 0 THEN 'pong' WHEN event_id % 3 = 1 OR event_id % 4 = 3 THEN 'ignored' ELSE 'queued' END AS outcome, user_id AS pr FROM events""")
def webhook_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of signed webhook events."""
    @F.pandas_udf("string")
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: "sha256=" + hmac.new(b"key", b.encode(), hashlib.sha256).hexdigest())

    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("event_id") % n).cast("int"))
    body = F.concat(F.lit('{"action": "'), pick(4, "opened", "synchronize", "reopened", "closed"), F.lit('", "pull_request": {"number": '), "user_id", F.lit(', "url": "u"}, "repository": {"full_name": "r"}}'))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", pick(3, "ping", "push", "pull_request").alias("event"), body.alias("body"))
    events = events.withColumn("signature", F.when(F.col("event_id") % 5 == 0, "sha256=00").otherwise(sign("body")))
    return webhook.routed(events, "key").select("event_id", "status", "outcome", "pr")


@query()
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the pattern rules in every document and every page."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("code"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("html").alias("code"))
    return X.scan_table(docs.unionByName(pages), "key", "code")


@query()
def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the lines that the diffs add, with severities, in order of gravity."""
    lines = N.parse_diffs(_diffs(spark, sf_dir, ".js"))
    found = X.scan_table(N.new_sides(lines).withColumn("key", F.struct("diff_id", "path")), "key", "text")
    placed = found.select(F.col("key.diff_id").alias("diff_id"), F.col("key.path").alias("path"), "line", "cwe", "rule_id", "confidence", "evidence")
    return N.on_added_lines(placed, lines).withColumn("severity", taxonomy.severity(F.col("cwe")))


@query(_CORPUS + "SELECT row_id, label, CASE WHEN row_id % 9 = 8 THEN 'safe' ELSE CASE row_id % 9 WHEN 0 THEN 'safe' WHEN 1 THEN 'CWE-89' WHEN 2 THEN 'MEMORY-OOB' WHEN 3 THEN 'MEMORY-OOB' WHEN 4 THEN 'CWE-20' WHEN 5 THEN 'CWE-476' WHEN 6 THEN 'safe' ELSE 'CWE-94' END END AS predicted, row_id % 9 IN (6, 8) AS outside FROM lab")
def predictions_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of an older label set on the classes."""
    raw = F.get(F.array(*map(F.lit, ["safe", "CWE-89", "CWE-119", "CWE-125", "CWE-20", "CWE-476", "CWE-416", "CWE-94", "CWE-190"])), (F.col("row_id") % 9).cast("int"))
    rows = labelled(spark, sf_dir).withColumn("f", taxonomy.fold_prediction(raw))
    return rows.select("row_id", "label", F.col("f.label").alias("predicted"), F.col("f.outside").alias("outside"))


@query(_CORPUS + "SELECT source, count(*) AS n FROM lab GROUP BY source")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of each source, most first."""
    return M.histogram(labelled(spark, sf_dir), "source")


def _review_findings(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Findings by the REVIEW schema made of order lines, as rules or as a model would give them."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_partkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    cols = {
        "review_id": F.col("l_orderkey"), "seq": k.cast("int"), "file": F.concat(F.lit("f"), F.col("l_suppkey") % 2, F.lit(".py")), "line": (F.col("l_partkey") % 20 + 1 + (k if source == "llm" else F.lit(0))).cast("int"),
        "category": F.lit("security") if source == "rules" else F.when(k % 3 == 0, "bug").otherwise("security"), "severity": F.when(k % 2 == 0, "major").otherwise("critical"),
        "message": F.lit("sql injection"), "suggestion": F.lit("" if source == "rules" else "bind it"), "source": F.lit(source),
        "cwe": F.lit("CWE-89") if source == "rules" else F.lit(None).cast("string"), "rule_id": F.lit("R1") if source == "rules" else F.lit(None).cast("string"), "evidence": F.lit("x" if source == "rules" else ""),
    }
    return rows.select(*[c.alias(n) for n, c in cols.items()])


@query()
def reviews_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's findings merged into those of rules, review by review."""
    return N.merge_review(_review_findings(spark, sf_dir, "rules"), _review_findings(spark, sf_dir, "llm"))


@query()
def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment for each review, from its merged findings by gravity."""
    found = R.ordered_by_severity(reviews_merged(spark, sf_dir), taxonomy.severity_rank(F.col("severity")))
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.lit("Summary.").alias("summary")).distinct()
    return R.comments(reviews, found)


@query("SELECT l_orderkey AS review_id, CAST(l_linenumber AS INTEGER) AS seq, 'f' || (x.s % 2) || '.py:' || (x.p % 20 + 1) || ' — CWE-89 (R1)' AS issue FROM (SELECT l_orderkey, l_linenumber, min({'s': l_suppkey, 'p': l_partkey}) AS x FROM lineitem GROUP BY ALL)")
def known_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that tell a model what rules have found."""
    return R.known_issues(_review_findings(spark, sf_dir, "rules")).select("review_id", "seq", "issue")
