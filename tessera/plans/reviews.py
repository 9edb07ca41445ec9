"""Queries on diffs and reviews with planted cases, and SQL that says what has to come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import taxonomy
from tessera.operators import findings as N
from tessera.operators import review as R
from tessera.operators import rules as X
from tessera.plans import planted
from tessera.plans.queries import query
from tessera.sources.corpus import table

_FIELDS = ("seq", "file", "line", "category", "severity", "message", "suggestion", "source", "cwe", "rule_id", "evidence")


def _rule(seq, file, line, severity, cwe, message="m"):
    return (seq, file, line, "security", severity, message, "r", "rules", cwe, "R" + str(seq), "e" + str(seq))


def _model(seq, file, line, category, severity, message, suggestion="s"):
    return (seq, file, line, category, severity, message, suggestion, "llm", None, None, "")


#: (rule findings, a model's findings, what they are merged into: source, severity, suggestion and message of each, in order).
CASES = [
    # within three lines: one finding, graver severity, the model's advice
    ([_rule(0, "a.py", 10, "minor", "CWE-200")], [_model(0, "a.py", 13, "security", "critical", "x", "fix")], [("llm+rules", "critical", "fix", "m")]),
    # four lines apart: two findings
    ([_rule(0, "a.py", 10, "minor", "CWE-200")], [_model(0, "a.py", 14, "security", "critical", "x", "fix")], [("rules", "minor", "r", "m"), ("llm", "critical", "fix", "x")]),
    # other categories and other files never restate
    ([_rule(0, "a.py", 10, "major", "CWE-79")], [_model(0, "a.py", 10, "bug", "major", "x"), _model(1, "b.py", 10, "security", "major", "y")], [("rules", "major", "r", "m"), ("llm", "major", "s", "x"), ("llm", "major", "s", "y")]),
    # without a line words decide; a blank suggestion and a lesser severity change nothing
    ([_rule(0, "a.py", 10, "critical", "CWE-89")], [_model(0, "./a.py", None, "security", "minor", "an SQL Injection", " ")], [("llm+rules", "critical", "r", "m")]),
    ([_rule(0, "a.py", 10, "critical", "CWE-89")], [_model(0, "a.py", None, "security", "minor", "an XSS")], [("rules", "critical", "r", "m"), ("llm", "minor", "s", "an XSS")]),
    # a rule finding takes one restatement only; the first that fits is taken
    ([_rule(0, "a.py", 10, "minor", "CWE-200"), _rule(1, "a.py", 12, "minor", "CWE-79")], [_model(0, "a.py", 11, "security", "info", "x", "p"), _model(1, "a.py", 11, "security", "info", "y", "q"), _model(2, "a.py", 11, "security", "info", "z", "o")],
     [("llm+rules", "minor", "p", "m"), ("llm+rules", "minor", "q", "m"), ("llm", "info", "o", "z")]),
    # one side only
    ([_rule(0, "a.py", None, "major", "CWE-502")], [], [("rules", "major", "r", "m")]),
    ([], [_model(0, "a.py", 1, "style", "info", "x")], [("llm", "info", "s", "x")]),
]


def _planted(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """A review for each document, with the findings of one side of its case."""
    kind = "k int, seq int, file string, line int, category string, severity string, message string, suggestion string, source string, cwe string, rule_id string, evidence string"
    cases = spark.createDataFrame([(k, *f) for k, case in enumerate(CASES) for f in case[side]], kind)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % len(CASES)).cast("int").alias("k"))
    # a handful of rows
    return docs.join(F.broadcast(cases), "k").select("review_id", *_FIELDS)


_MERGED = f"v(k, seq, source, severity, suggestion, message) AS (VALUES {planted.values([(k, i, *x) for k, case in enumerate(CASES) for i, x in enumerate(case[2])])})"


@query(f"WITH {_MERGED} SELECT doc_id AS review_id, CAST(seq AS INTEGER) AS seq, v.source, severity, suggestion, message FROM documents JOIN v ON doc_id % {len(CASES)} = k")
def reviews_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's findings merged into those of rules, case by case."""
    merged = N.merge_review(_planted(spark, sf_dir, 0), _planted(spark, sf_dir, 1))
    return merged.select("review_id", "seq", "source", "severity", "suggestion", "message")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"


@query(f"""WITH f(k, seq, file, line, category, severity, message, suggestion) AS (VALUES {planted.values([(k, *f[:7]) for k, case in enumerate(CASES) for f in case[1]])})
SELECT doc_id AS review_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, file, coalesce(line, 0), seq) - 1 AS INTEGER) AS seq, message FROM documents JOIN f ON doc_id % {len(CASES)} = k""")
def reviews_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's findings by severity, file and line."""
    return R.ordered_by_severity(_planted(spark, sf_dir, 1), taxonomy.severity_rank(F.col("severity"))).select("review_id", "seq", "message")


#: Comments of the cases, by hand: no finding, one of rules with a rule's mark, one of a model.
_HEAD, _FOOT = "## 🤖 AI PR Review\n\nSummary.\n\n", "---\n_Generated by AI PR Reviewer._"
_CAVEAT = "_🔎 findings come from deterministic pattern rules that fire only on constructs unsafe by definition. They are reproducible and carry a rule id, but they are not a substitute for review._\n\n"
COMMENTS = [
    ([], _HEAD + "✅ No issues found. Looks good!"),
    ([_rule(0, "a.py", 3, "critical", "CWE-89")], _HEAD + "**1 finding(s):**\n\n### 🔴 CRITICAL · security — `a.py`:3  ·  🔎 static analysis · `R0`\nm\n```\ne0\n```\n> **Suggestion:** r\n\n" + _CAVEAT + _FOOT),
    ([_model(0, "b.py", None, "style", "info", "say so", "")], _HEAD + "**1 finding(s):**\n\n### 🔵 INFO · style — `b.py`\nsay so\n\n" + _FOOT),
    ([_model(0, "b.py", 4, "bug", "major", "x", "y"), _model(1, "b.py", 9, "refactor", "minor", "z", "")], _HEAD + "**2 finding(s):**\n\n### 🟠 MAJOR · bug — `b.py`:4\nx\n> **Suggestion:** y\n\n### 🟡 MINOR · refactor — `b.py`:9\nz\n\n" + _FOOT),
]


@query(f"WITH v(k, comment) AS (VALUES {planted.values([(k, c) for k, (_, c) in enumerate(COMMENTS)])}) SELECT doc_id AS review_id, comment FROM documents JOIN v ON doc_id % {len(COMMENTS)} = k")
def comments_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of planted reviews."""
    kind = "k int, seq int, file string, line int, category string, severity string, message string, suggestion string, source string, cwe string, rule_id string, evidence string"
    cases = spark.createDataFrame([(k, *f) for k, (found, _) in enumerate(COMMENTS) for f in found], kind)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % len(COMMENTS)).cast("int").alias("k"))
    return R.comments(docs.select("review_id", F.lit("Summary.").alias("summary")), docs.join(F.broadcast(cases), "k").drop("k"))


#: Diffs with what they show of the new side: (text, [(path, line, text, added)]), and the files worth scanning.
DIFFS = [
    ("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+eval(b)\n c\n@@ -10 +11,2 @@ def f\n-old\n+++ new\n+d", [("x.py", 1, "a", False), ("x.py", 2, "eval(b)", True), ("x.py", 3, "c", False), ("x.py", 11, "++ new", True), ("x.py", 12, "d", True)]),
    ("diff --git a/gone.py b/gone.py\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\ndiff --git a/lib/m.js b/lib/m.js\n--- a/lib/m.js\n+++ b/lib/m.js\t2020\n@@ -0,0 +5,1 @@\n+var q = 1;\n\\ No newline at end of file", [("lib/m.js", 5, "var q = 1;", True)]),
    ("diff --git a/a.bin b/a.bin\nBinary files differ\ndiff --git a/t.txt b/t.txt\n--- a/t.txt\n+++ b/t.txt\n@@ -1,1 +1,1 @@\n-x\n+y", [("t.txt", 1, "y", True)]),
    ("--- a/only.py\n+++ b/only.py\n@@ -1,2 +1,1 @@\n a\n-b", []),
    ("", []),
]


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.chosen(spark, sf_dir, [d for d, _ in DIFFS]).select(F.col("doc_id").alias("diff_id"), F.col("code").alias("diff"))


@query(f"WITH v(k, path, line, text, is_added) AS (VALUES {planted.values([(k, p, n, t, int(a)) for k, (_, shown) in enumerate(DIFFS) for p, n, t, a in shown])}) SELECT doc_id AS diff_id, path, CAST(line AS INTEGER) AS line, v.text, is_added = 1 AS is_added FROM documents JOIN v ON doc_id % {len(DIFFS)} = k")
def diffs_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new sides of planted diffs: several hunks and files, deleted and binary ones, lines that look like headers."""
    return N.parse_diffs(_diffs(spark, sf_dir)).select("diff_id", "path", "line", "text", "is_added")


@query(f"SELECT doc_id AS diff_id, 'x.py' AS path, 'a' || chr(10) || 'eval(b)' || chr(10) || 'c' || repeat(chr(10), 8) || '++ new' || chr(10) || 'd' AS text FROM documents WHERE doc_id % {len(DIFFS)} = 0 UNION ALL SELECT doc_id, 'lib/m.js', repeat(chr(10), 4) || 'var q = 1;' FROM documents WHERE doc_id % {len(DIFFS)} = 1")
def new_sides_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files worth scanning of planted diffs, line by line in their places."""
    return N.new_sides(N.parse_diffs(_diffs(spark, sf_dir))).select("diff_id", "path", "text")


@query("SELECT doc_id AS diff_id, i AS ordinal, 'f' || i || '.py' AS path FROM documents, range(20) r(i)")
def files_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of diffs with 25 files the first 20: the cap is what is asked for."""
    many = "".join(f"diff --git a/f{i}.py b/f{i}.py\n--- a/f{i}.py\n+++ b/f{i}.py\n@@ -1,0 +1,1 @@\n+x{i}\n" for i in range(25))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.lit(many).alias("diff"))
    return N.new_sides(N.parse_diffs(docs)).select("diff_id", F.col("ordinal").cast("long").alias("ordinal"), "path")


#: Files of one added and one old line each, with the findings that remain.
_CODE = ["var q = f();\nel.innerHTML = q;", "char b[8];\ngets(b);", "cur.execute('SELECT a FROM t WHERE id=' + x)", "int a;\nint b;"]

@query(f"""WITH v(k, cwe, line, severity, message) AS (VALUES (0, 'CWE-79', 2, 'major', 'Cross-Site Scripting (XSS) — this line matches a pattern that is unsafe by definition (CWE-79).'), (2, 'CWE-89', 1, 'critical', 'SQL Injection — this line matches a pattern that is unsafe by definition (CWE-89).'))
SELECT doc_id AS review_id, CAST(0 AS INTEGER) AS seq, 'src/f' || doc_id || '.js' AS file, CAST(line AS INTEGER) AS line, severity, message, 'rules' AS source FROM documents JOIN v ON doc_id % {len(_CODE)} = k""")
def diff_findings_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings on the lines that planted diffs add, as review findings; in the second code the found line is old."""
    rows = planted.chosen(spark, sf_dir, _CODE)
    path, n = F.concat(F.lit("src/f"), "doc_id", F.lit(".js")), F.size(F.split("code", "\n"))
    old = F.col("doc_id") % len(_CODE) == 1
    body = F.array_join(F.transform(F.split("code", "\n"), lambda x, i: F.concat(F.when(old & (i == 1), " ").otherwise("+"), x)), "\n")
    head = F.concat(F.lit("diff --git a/x b/x\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), F.when(old, 1).otherwise(0), F.lit(" +1,"), n, F.lit(" @@\n"))
    found = scan_diffs(rows.select(F.col("doc_id").alias("diff_id"), F.concat(head, body).alias("diff")))
    return R.of_rules(found).select("review_id", "seq", "file", "line", "severity", "message", "source")


def scan_diffs(diffs: DataFrame) -> DataFrame:
    """Rule findings (diff_id, path, line, ...) on the lines that diffs add."""
    lines = N.parse_diffs(diffs)
    found = X.scan_table(N.new_sides(lines).withColumn("key", F.struct("diff_id", "path")), "key", "text")
    placed = found.select(F.col("key.diff_id").alias("diff_id"), F.col("key.path").alias("path"), "line", "cwe", "name", "rule_id", "confidence", "evidence")
    return N.on_added_lines(placed, lines)


_ISSUES = ["a.py:3 — CWE-89 (R1)", "b.py — CWE-79 (R2)"]
_PIECES = R.PROMPT.replace("{{", "{").replace("}}", "}")
_BEFORE, _REST = _PIECES.split("{known}")
_MIDDLE, _REST = _REST.split("{standards}")
_AFTER, _LAST = _REST.split("{diff}")
_KNOWN = R.KNOWN.replace("{issues}", "- " + "\n- ".join(_ISSUES))


@query(f"SELECT doc_id, md5({planted.quoted(_BEFORE)} || CASE WHEN doc_id % 2 = 0 THEN {planted.quoted(_KNOWN)} ELSE '' END || {planted.quoted(_MIDDLE)} || CASE WHEN doc_id % 3 = 0 THEN '(none provided)' ELSE 'Be brief.' END || {planted.quoted(_AFTER)} || coalesce(text, '') || {planted.quoted(_LAST)}) AS digest FROM documents")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of prompts for every document as a diff, with and without known issues and standards."""
    k = F.col("doc_id")
    issues = F.when(k % 2 == 0, F.array(*map(F.lit, _ISSUES)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.prompt(F.col("text"), F.when(k % 3 == 0, "").otherwise("Be brief."), issues)).alias("digest"))


@query("""SELECT doc_id AS response_id, doc_id % 4 <> 3 AS ok, CASE doc_id % 4 WHEN 0 THEN 'all well' WHEN 1 THEN '' WHEN 2 THEN 'two' ELSE '' END AS summary, CAST(i AS INTEGER) AS seq,
  CASE WHEN i = 0 THEN 'a.py' WHEN i = 1 THEN 'b.py' END AS file FROM documents, LATERAL (SELECT unnest(CASE WHEN doc_id % 4 = 2 THEN [0, 1] ELSE [NULL::INTEGER] END) AS i) t""")
def reviews_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers without findings, without fences, with prose around, and with bad JSON."""
    raw = ['{"summary": "all well", "findings": []}', "```\n{}\n```", 'Sure: {"summary": "two", "findings": [{"file": "a.py"}, {"file": "b.py"}]} - done', "{not json"]
    return R.parse_reviews(planted.chosen(spark, sf_dir, raw).select(F.col("doc_id").alias("response_id"), F.col("code").alias("raw"))).select("response_id", "ok", "summary", "seq", "file")
