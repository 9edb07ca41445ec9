"""Queries on splits, classes and detectors as a whole, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import decision, taxonomy, tfidf
from tessera.operators import corpus as C
from tessera.operators import findings as N
from tessera.operators import metrics as M
from tessera.plans import planted
from tessera.plans.queries import _C_SQL, _CORPUS, _P_SQL, _PRED_SQL, _PRF, _REPORT_SQL, _TALLY, CLASS_LIST, detections, labelled, predictions, probabilities, query
from tessera.sources.corpus import column_or, table

#: Classes that a smaller taxonomy leaves out here.
WEAK = ["CWE-20", "CWE-200"]
_LISTED = ", ".join(f"'{c}'" for c in CLASS_LIST)
_MACRO = f"""t AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp,
  count(*) FILTER (gold = label AND predicted <> label) AS fn FROM (SELECT unnest([{_LISTED}]) AS label), x GROUP BY label), f AS (SELECT sum(f1) / {len(CLASS_LIST)} AS m, sum(support)::BIGINT AS n FROM (SELECT *, {_PRF} FROM t))"""


@query(_CORPUS + "SELECT split, count(DISTINCT label) AS n_classes FROM lab GROUP BY split")
def classes_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct classes of each split."""
    return labelled(spark, sf_dir).groupBy("split").agg(F.count_distinct("label").alias("n_classes"))


@query(_CORPUS + "SELECT string_agg(DISTINCT label, ',' ORDER BY label) AS classes FROM lab")
def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that the corpus has, in order."""
    return labelled(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("classes"))


@query(_CORPUS + "SELECT CASE WHEN least(3, min(n)) >= 2 THEN least(3, min(n)) END AS folds FROM (SELECT count(*) AS n FROM lab WHERE split = 'train' GROUP BY label)")
def calibration_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that the rarest class of the training split allows."""
    return M.calibration_folds(labelled(spark, sf_dir).where("split = 'train'"))


@query(_CORPUS + "SELECT row_id, split, label FROM lab WHERE label NOT IN ('CWE-20', 'CWE-200')")
def classes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the weak classes."""
    return C.partition_classes(labelled(spark, sf_dir), WEAK)[0].select("row_id", "split", "label")


@query(_CORPUS + _PRED_SQL + ", r AS (SELECT * FROM pred WHERE gold IN ('CWE-20', 'CWE-200')), s AS (SELECT count(*) AS n_rows, count(*) FILTER (predicted <> 'safe') AS still_flagged FROM r) SELECT predicted, count(*) AS n, any_value(n_rows) AS n_rows, any_value(still_flagged) AS still_flagged, round(any_value(still_flagged) / any_value(n_rows)::DOUBLE, 4) AS fraction_still_flagged FROM r, s GROUP BY predicted")
def coverage_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is predicted for rows of the classes left out."""
    return M.coverage_loss(C.partition_classes(predictions(spark, sf_dir).withColumn("label", F.col("gold")), WEAK)[1])


@query(_CORPUS + ", x AS (SELECT label AS gold, CASE WHEN row_id % 3 <> 2 THEN label ELSE coalesce(named[-1], 'safe') END AS predicted, dup_of_train FROM det WHERE split <> 'train'), "
       + _MACRO + ", a AS (SELECT * FROM f), b AS (WITH x AS (SELECT label AS gold, CASE WHEN row_id % 3 <> 2 THEN label ELSE coalesce(named[-1], 'safe') END AS predicted FROM det WHERE NOT dup_of_train), " + _MACRO
       + " SELECT * FROM f) SELECT a.n AS n_all, a.m AS f1_all, b.n AS n_unseen, b.m AS f1_unseen, a.m - b.m AS premium FROM a, b")
def memorisation_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better a classifier looks on rows that training has too."""
    rows = detections(spark, sf_dir).where("split <> 'train'").select("row_id", "dup_of_train").join(predictions(spark, sf_dir), "row_id")
    return M.memorisation_premium(rows, CLASS_LIST)


@query(_CORPUS + _REPORT_SQL + ", u AS (SELECT DISTINCT label FROM lab) SELECT avg(f1) AS f1_present, (SELECT sum(f1) FROM p WHERE label IN (SELECT label FROM u)) / (SELECT count(*) FROM u) AS f1_union FROM p")
def macro_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 over the labels that occur in gold or predictions, and over the labels that the splits have."""
    report = M.report(M.confusion(predictions(spark, sf_dir))).persist()
    union = sorted(r[0] for r in labelled(spark, sf_dir).select("label").distinct().collect())  # classes
    one = lambda domain, name: M.summary(report, domain).select(F.col("macro_f1").alias(name))
    return one(None, "f1_present").join(F.broadcast(one(union, "f1_union")))


@query(_CORPUS + f""", h AS (SELECT {_TALLY} FROM det), u AS (SELECT {_TALLY} FROM det WHERE NOT coalesce(dup_of_train, false)),
hp AS (SELECT *, {_PRF}, fp / (fp + tn)::DOUBLE AS fire FROM h), up AS (SELECT *, {_PRF} FROM u),
c AS (SELECT l.label, count(*) FILTER (d.label = l.label) AS support, count(*) FILTER (d.label = l.label AND list_contains(named, l.label)) AS tp, count(*) FILTER (d.label <> l.label AND list_contains(named, l.label)) AS fp, count(*) FILTER (d.label = l.label AND NOT list_contains(named, l.label)) AS fn
  FROM (SELECT unnest([{_LISTED}]) AS label) l, det d WHERE l.label <> 'safe' GROUP BY l.label),
m AS (SELECT avg(f1) AS macro FROM (SELECT *, {_PRF} FROM c) WHERE support > 0),
v AS (SELECT *, CASE WHEN row_id % 8 < 4 THEN []::VARCHAR[] ELSE named END AS after FROM det WHERE is_vulnerable AND trim(code_fixed) <> '' AND code_fixed <> code),
x AS (SELECT count(*) FILTER (len(after) > 0) / count(*)::DOUBLE AS fixed, count(*) FILTER (list_contains(named, label) AND NOT list_contains(after, label)) / nullif(count(*) FILTER (list_contains(named, label)), 0)::DOUBLE AS sens FROM v)
SELECT hp.precision AS binary_precision, hp.recall AS binary_recall, hp.f1 AS binary_f1, fire AS fire_rate_on_safe_rows, up.f1 AS binary_f1_unseen_only, macro AS cwe_macro_f1, fixed AS fire_rate_on_patched_code_upper_bound, coalesce(sens, 0.0) AS patch_sensitivity FROM hp, up, m, x""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures to quote for a detector."""
    rows = detections(spark, sf_dir)
    after = F.when(F.col("row_id") % 8 < 4, F.array().cast("array<string>")).otherwise(F.col("named"))
    pairs = rows.where(taxonomy.has_patch(F.col("is_vulnerable"), F.col("code"), F.col("code_fixed"))).select("gold", F.col("named").alias("on_vuln"), after.alias("on_fixed"))
    return M.headline(rows, pairs)


@query(_CORPUS + "SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(named, CASE row_id % 3 WHEN 0 THEN ['CWE-502'] WHEN 1 THEN ['CWE-89', 'CWE-79'] ELSE [] END))), ',') AS named FROM det")
def hybrid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier or rules name, row by row."""
    k = F.col("row_id") % 3
    rules = F.when(k == 0, F.array(F.lit("CWE-502"))).when(k == 1, F.array(F.lit("CWE-89"), F.lit("CWE-79"))).otherwise(F.array().cast("array<string>"))
    return detections(spark, sf_dir).select("row_id", F.array_join(N.hybrid(F.col("named"), rules), ",").alias("named"))


@query(_CORPUS + ", k AS (SELECT split, code_hash FROM lab WHERE split <> 'train' OR code_hash NOT IN (SELECT code_hash FROM lab WHERE split <> 'train')), c AS (SELECT (SELECT count(*) FROM (SELECT code_hash FROM lab WHERE split = 'train' INTERSECT SELECT code_hash FROM lab WHERE split <> 'train')) AS before, (SELECT count(*) FROM (SELECT code_hash FROM k WHERE split = 'train' INTERSECT SELECT code_hash FROM k WHERE split <> 'train')) AS after) SELECT * FROM c")
def splits_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that training shares with the other splits, before and after leaks are dropped."""
    rows = labelled(spark, sf_dir)
    return C.common_codes(rows).agg(F.count("*").alias("before")).join(F.broadcast(C.common_codes(C.drop_leaks(rows)).agg(F.count("*").alias("after"))))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'CWE-89=' || (doc_id % 7)::DOUBLE || ',safe=-1000000000.0' ELSE 'CWE-89=-1000000000.0,safe=' || (doc_id % 5)::DOUBLE END AS scores FROM documents")
def scores_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models with a class each, on both classes."""
    k = F.col("doc_id")
    own = F.when(k % 2 == 0, F.create_map(F.lit("CWE-89"), (k % 7).cast("double"))).otherwise(F.create_map(F.lit("safe"), (k % 5).cast("double")))
    s = decision.aligned(own, ["CWE-89", "safe"])
    shown = lambda i: F.when(F.get(s, F.lit(i)) <= -1e9, "-1000000000.0").otherwise(F.get(s, F.lit(i)).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("CWE-89="), shown(0), F.lit(",safe="), shown(1)).alias("scores"))


@query("SELECT CAST(0 AS BIGINT) AS n_different, count(*) AS n_rows FROM documents")
def decisions_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by the column rule against those by an aggregate over exploded scores: rows in which they differ."""
    rows = probabilities(spark, sf_dir)
    named = F.zip_with(F.array(*map(F.lit, CLASS_LIST)), F.col("probs"), lambda c, p: F.struct(c.alias("label"), p.alias("p")))
    one = rows.select("doc_id", decision.decide(F.col("probs"), CLASS_LIST).alias("predicted"))
    other = M.top_class(rows.select("doc_id", named.alias("scores")), "doc_id")
    return M.differences(one, other).agg(F.count("*").alias("n_different")).join(F.broadcast(one.agg(F.count("*").alias("n_rows"))))


@query(_CORPUS + "SELECT row_id, label FROM lab ORDER BY row_id LIMIT 50")
def smoke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 labelled rows: the limit is what is asked for."""
    return labelled(spark, sf_dir).orderBy("row_id").limit(50).select("row_id", "label")


@query("SELECT doc_id, coalesce(lang, '') AS lang, 'none' AS missing, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as texts, with a default for one that isn't there."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", column_or(docs, "lang").alias("lang"), column_or(docs, "no_such_column", "none").alias("missing"), column_or(docs, "n_chars").alias("n_chars"))


_FOUND = "WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, 'CWE-' || (l_partkey % 3) AS cwe, CAST(l_discount AS DOUBLE) AS confidence, CAST(l_suppkey % 5 AS INTEGER) AS line, 'R' || (l_suppkey % 4) AS rule_id FROM lineitem) "


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as findings."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("CWE-"), F.col("l_partkey") % 3).alias("cwe"), F.col("l_discount").cast("double").alias("confidence"), (F.col("l_suppkey") % 5).cast("int").alias("line"), F.concat(F.lit("R"), F.col("l_suppkey") % 4).alias("rule_id"))


@query(_FOUND + "SELECT doc_id, cwe, line, confidence, rule_id FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, cwe, line ORDER BY confidence DESC, seq, rule_id) = 1")
def best_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident finding of each class and line, the first of equals."""
    return N.first_per(_found(spark, sf_dir), ["doc_id", "cwe", "line"], F.desc("confidence"), F.col("seq"), F.col("rule_id")).select("doc_id", "cwe", "line", "confidence", "rule_id")


@query(_FOUND + "SELECT doc_id, line, rule_id, count(*) AS n FROM (SELECT DISTINCT doc_id, rule_id, line FROM f) GROUP BY ALL")
def findings_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each rule and line."""
    one = N.first_per(_found(spark, sf_dir), ["doc_id", "rule_id", "line"], F.col("seq"))
    return one.groupBy("doc_id", "line", "rule_id").agg(F.count("*").alias("n"))


@query(_FOUND + "SELECT doc_id, string_agg(DISTINCT cwe, ',' ORDER BY cwe) AS named FROM f GROUP BY doc_id")
def finding_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that each document's findings name."""
    return N.named_sets(_found(spark, sf_dir)).select("doc_id", F.array_join("named", ",").alias("named"))


@query(_FOUND + "SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(line, 0), confidence DESC, rule_id, seq) AS place FROM f")
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of findings by line, falling confidence and rule."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*N.finding_order(), F.col("seq")))
    return _found(spark, sf_dir).select("doc_id", "seq", place.cast("long").alias("place"))


_PATHS = [("b/src/a.py\t2020-01-01", "src/a.py", True), ('"b/src/x y.js"', "src/x y.js", True), ("`a/lib\\m.go`", "lib/m.go", True), ("././/abs/n.c", "abs/n.c", True), ("src/tests/t.py", "src/tests/t.py", False), ("README", "README", False), ("b/.env", ".env", False), ("web/app.min.js", "web/app.min.js", False), ("  x/test_y.py ", "x/test_y.py", False)]


@query(f"WITH v(k, path) AS (VALUES {planted.values([(k, p) for k, (_, p, _) in enumerate(_PATHS)])}) SELECT doc_id, path, k < 4 AS scannable FROM documents JOIN v ON doc_id % {len(_PATHS)} = k")
def paths_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as diffs write them, put right, and whether they are worth scanning."""
    rows = planted.chosen(spark, sf_dir, [p for p, _, _ in _PATHS])
    return rows.select("doc_id", taxonomy.normal_path(F.col("code")).alias("path"), taxonomy.scannable(F.col("code")).alias("scannable"))


_IDS = [*taxonomy.CLASSES, *taxonomy.MERGED, "safe", "CWE-999"]
_DESCRIBED = [(k, taxonomy.MERGED.get(c, c) if c in taxonomy.MERGED or c in taxonomy.CLASSES else None) for k, c in enumerate(_IDS)]


@query(f"""WITH v(k, cwe) AS (VALUES {planted.values(_DESCRIBED)}) SELECT doc_id, cwe, CASE cwe WHEN 'CWE-89' THEN 'SQL Injection' WHEN 'CWE-79' THEN 'Cross-Site Scripting (XSS)' WHEN 'CWE-94' THEN 'Code Injection'
  WHEN 'CWE-502' THEN 'Insecure Deserialization' WHEN 'CWE-20' THEN 'Improper Input Validation' WHEN 'CWE-200' THEN 'Information Exposure' WHEN 'CWE-476' THEN 'NULL Pointer Dereference' WHEN 'MEMORY-OOB' THEN 'Out-of-bounds Memory Access' END AS name,
  CASE WHEN cwe IN ('CWE-89', 'CWE-94', 'CWE-502') THEN 'critical' WHEN cwe IN ('CWE-476', 'CWE-200', 'CWE-20') THEN 'minor' ELSE 'major' END AS severity, cwe IS NOT NULL AND cwe <> 'CWE-20' AS has_remedy FROM documents JOIN v ON doc_id % {len(_IDS)} = k""")
def labels_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with names, severities and advice, older ids by the class they merged into."""
    rows = planted.chosen(spark, sf_dir, _IDS).withColumn("d", taxonomy.describe(F.col("code")))
    return rows.select("doc_id", F.col("d.cwe").alias("cwe"), F.col("d.name").alias("name"), taxonomy.severity(F.col("d.cwe")).alias("severity"), (F.length(taxonomy.remedy(F.col("d.cwe"))) > 0).alias("has_remedy"))


_SAID = [("Possible SQLi here", "CWE-89", True), ("a buffer overflow may follow", "MEMORY-OOB", True), ("Use innerHTML with care", "CWE-79", True), ("the null pointer", "CWE-89", False), ("eval( of input", "CWE-94", True), ("nothing of the kind", "CWE-502", False), ("weak hash of a password", "CWE-200", True), ("", "CWE-79", False), ("sql injection", "CWE-20", False)]


@query(f"SELECT doc_id, doc_id % {len(_SAID)} IN ({', '.join(str(k) for k, x in enumerate(_SAID) if x[2])}) AS said FROM documents")
def keywords_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts speak of a class's defect."""
    rows = planted.chosen(spark, sf_dir, [t for t, _, _ in _SAID]).withColumn("cwe", F.get(F.array(*[F.lit(c) for _, c, _ in _SAID]), (F.col("doc_id") % len(_SAID)).cast("int")))
    return rows.select("doc_id", N.mentions(F.col("code"), F.col("cwe")).alias("said"))


@query(f"""WITH p AS (SELECT doc_id, unnest({_C_SQL}) AS label, unnest({_P_SQL}) AS w, list_sum({_P_SQL}) AS s, unnest(range({len(CLASS_LIST)})) AS i FROM documents),
ml AS (SELECT doc_id, label AS cwe, round(w / s, 3) AS m, i FROM p WHERE label <> 'safe' AND w / s >= 0.15),
top AS (SELECT doc_id, label, w / s AS pr FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i) = 1),
r(k, cwe, confidence) AS (VALUES {planted.values([(k, r[2], r[3]) for k, r in enumerate(planted.RULES) if r[1]])}),
rf AS (SELECT doc_id, cwe, CAST(confidence AS DOUBLE) AS c FROM documents JOIN r ON doc_id % {len(planted.RULES)} = k),
f AS (SELECT doc_id, cwe, CASE WHEN c IS NULL THEN 'ml' WHEN m IS NULL THEN 'rule' ELSE 'ml+rule' END AS source, round(greatest(m, c), 3) AS confidence FROM ml FULL JOIN rf USING (doc_id, cwe)),
g AS (SELECT doc_id, string_agg(cwe || ':' || source, ',' ORDER BY confidence DESC, source = 'rule', cwe) AS found FROM f GROUP BY doc_id)
SELECT doc_id, label AS top_prediction, round(pr, 3) AS top_confidence, found IS NOT NULL AS is_vulnerable, coalesce(found, '') AS found FROM top LEFT JOIN g USING (doc_id)""")
def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: a classifier's classes over a threshold, the rules' findings, both merged, by falling confidence."""
    ranked = probabilities(spark, sf_dir).select("doc_id", decision.ranked(F.col("probs"), CLASS_LIST).alias("ranking"))
    each = ranked.select("doc_id", F.inline("ranking")).where((F.col("label") != taxonomy.SAFE) & (F.col("p") >= 0.15))
    ml = each.select("doc_id", F.col("label").alias("cwe"), F.round("p", 3).alias("confidence"))
    codes = planted.chosen(spark, sf_dir, [r[0] for r in planted.RULES])
    merged = N.merge_detectors(ml, planted.X.scan_table(codes, "doc_id", "code"))
    found = F.array_join(F.transform("findings", lambda x: F.concat(x["cwe"], F.lit(":"), x["source"])), ",")
    return N.scan_results(merged, ranked).select("doc_id", "top_prediction", "top_confidence", "is_vulnerable", found.alias("found"))


query(planted.RULES_SQL)(planted.rules_planted)
query(planted.FEATURES_SQL)(planted.features_planted)


def _tfidf_sql(grams: str, min_df: int, max_terms: int) -> str:
    return _CORPUS + f""", g AS (SELECT * FROM (SELECT row_id, unnest({grams}) AS term FROM lab) WHERE term IS NOT NULL), c AS (SELECT row_id, term, count(*) AS tf FROM g GROUP BY ALL),
k AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= {min_df} ORDER BY sum(tf) DESC, term LIMIT {max_terms}),
w AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM lab)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN k USING (term))
SELECT row_id, count(*) AS n_terms, round(max(w) / sqrt(sum(w * w)), 6) AS heaviest, round(sum(w) / sqrt(sum(w * w)), 5) AS total FROM w GROUP BY row_id"""


def _weights(spark: SparkSession, sf_dir: str, grams) -> DataFrame:
    """Of each row the number of terms, the heaviest weight and their sum: a digest of its vector."""
    weights = tfidf.tfidf(labelled(spark, sf_dir), "row_id", grams(F.col("code")))
    return weights.groupBy("row_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 5).alias("total"))


@query(_tfidf_sql(f"list_concat(regexp_extract_all(lower(code), '{tfidf.TOKEN}'), list_transform(list_zip(regexp_extract_all(lower(code), '{tfidf.TOKEN}'), regexp_extract_all(lower(code), '{tfidf.TOKEN}')[2:]), lambda x: x[1] || ' ' || x[2]))", 3, 20_000))
def tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of words and pairs of neighbours."""
    return _weights(spark, sf_dir, tfidf.word_grams)
