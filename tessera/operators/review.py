"""Model reviews: reading their JSON, and writing comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.taxonomy import mapping, remedy, severity
from tessera.functions.text import strip

# Words that models use for categories and severities.
CATEGORIES = {c: c for c in ("bug", "security", "refactor", "style")} | {
    "error-handling": "bug", "errorhandling": "bug", "logic": "bug", "correctness": "bug",
    "vulnerability": "security", "security-vulnerability": "security",
    "performance": "refactor", "maintainability": "refactor",
    "readability": "style", "formatting": "style", "convention": "style",
}
SEVERITIES = {s: s for s in ("info", "minor", "major", "critical")} | {
    "high": "major", "medium": "minor", "moderate": "minor", "low": "minor", "warning": "minor",
    "blocker": "critical", "note": "info", "nit": "info",
}
# The parts of a comment.
MARKS = {"critical": "🔴", "major": "🟠", "minor": "🟡", "info": "🔵"}
BADGES = {"rules": "🔎 static analysis", "llm+rules": "🔎🤖 static analysis + model"}
TITLE, CLEAN, FOOT = "## 🤖 AI PR Review", "✅ No issues found. Looks good!", "_Generated by AI PR Reviewer._"
CAVEAT = "_🔎 findings come from deterministic pattern rules that fire only on constructs unsafe by definition. They are reproducible and carry a rule id, but they are not a substitute for review._"

ITEM = "array<struct<file:string,line:string,category:string,severity:string,message:string,suggestion:string>>"


def json_of(raw: Column) -> Column:
    """The JSON object inside a model's answer, without fences or prose."""
    t = strip(raw)
    fenced = F.regexp_replace(F.split_part(t, F.lit("```"), F.lit(2)), r"(?U)^\s*json", "")
    body = F.when(t.startswith("```"), fenced).otherwise(t)
    return F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), body)


def coerced(word: Column, known: dict[str, str], default: str) -> Column:
    """A word of a closed list, by its spelling or a synonym, else the default."""
    key = F.regexp_replace(F.lower(strip(F.coalesce(word, F.lit("")))), "[ _]", "-")
    return F.coalesce(F.try_element_at(mapping(known), key), F.lit(default))


def line_of(raw: Column) -> Column:
    """A line number from a number, a text or a range; null where there is none."""
    return F.when(raw.isin("", "0"), F.lit(None).cast("int")).otherwise(F.trim(F.split_part(raw, F.lit("-"), F.lit(1))).try_cast("int"))


def parse_reviews(responses: DataFrame, id_col: str = "response_id", raw: str = "raw") -> DataFrame:
    """(response_id, ok, summary, seq, file, line, category, severity, message, suggestion): a row for each finding, and one with a null seq for a review without any or with bad JSON."""
    parsed = F.from_json(json_of(F.col(raw)), f"summary string, findings {ITEM}")
    rows = responses.select(F.col(id_col), parsed.alias("r"), F.try_parse_json(json_of(F.col(raw))).isNotNull().alias("ok"))
    each = rows.select(id_col, "ok", F.coalesce("r.summary", F.lit("")).alias("summary"), F.posexplode_outer("r.findings").alias("seq", "f"))
    return each.select(
        id_col,
        "ok",
        "summary",
        "seq",
        F.col("f.file").alias("file"),
        line_of(F.col("f.line")).alias("line"),
        F.when(F.col("seq").isNotNull(), coerced(F.col("f.category"), CATEGORIES, "refactor")).alias("category"),
        F.when(F.col("seq").isNotNull(), coerced(F.col("f.severity"), SEVERITIES, "minor")).alias("severity"),
        F.col("f.message").alias("message"),
        F.when(F.col("seq").isNotNull(), F.coalesce("f.suggestion", F.lit(""))).alias("suggestion"),
    )


def known_issues(findings: DataFrame) -> DataFrame:
    """One line for each rule finding, for a prompt."""
    place = F.concat("file", F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), "line")).otherwise(""))
    return findings.withColumn("issue", F.concat(place, F.lit(" — "), F.coalesce("cwe", F.lit("security issue")), F.lit(" ("), F.coalesce("rule_id", F.lit("static rule")), F.lit(")")))


def comments(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, comment): Markdown for each review (review_id, summary) from its findings by the REVIEW schema, in order of seq."""
    badge = F.try_element_at(mapping(BADGES), F.col("source"))
    place = F.concat(F.lit("`"), "file", F.lit("`"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), "line")).otherwise(""))
    rule = F.when(F.length("rule_id") > 0, F.concat(F.lit(" · `"), "rule_id", F.lit("`"))).otherwise("")
    head = F.concat(F.lit("### "), F.coalesce(F.try_element_at(mapping(MARKS), F.col("severity")), F.lit("•")), F.lit(" "), F.upper("severity"), F.lit(" · "), "category", F.lit(" — "), place, F.coalesce(F.concat(F.lit("  ·  "), badge, rule), F.lit("")))
    evidence = F.when(F.length("evidence") > 0, F.concat(F.lit("```\n"), "evidence", F.lit("\n```")))
    advice = F.when(F.length("suggestion") > 0, F.concat(F.lit("> **Suggestion:** "), "suggestion"))
    block = F.concat(F.concat_ws("\n", head, "message", evidence, advice), F.lit("\n"))
    per = findings.withColumn("_block", block).withColumn("_badge", badge.isNotNull()).groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("seq", "_block"))).alias("b"), F.max("_badge").alias("badged"), F.count("*").alias("n"))
    rows = reviews.join(per, "review_id", "left")
    blocks = F.array_join(F.transform("b", lambda x: x["_block"]), "\n")
    full = F.concat_ws("\n", F.lit(TITLE), F.lit(""), "summary", F.lit(""), F.concat(F.lit("**"), "n", F.lit(" finding(s):**")), F.lit(""), blocks, F.when(F.col("badged"), F.lit(CAVEAT + "\n")), F.lit("---"), F.lit(FOOT))
    none = F.concat_ws("\n", F.lit(TITLE), F.lit(""), "summary", F.lit(""), F.lit(CLEAN))
    return rows.select("review_id", F.when(F.col("n").isNull(), none).otherwise(full).alias("comment"))


def ordered_by_severity(findings: DataFrame, rank: Column) -> DataFrame:
    """Numbers the findings of a review by severity, file and line."""
    return findings.withColumn("seq", (F.row_number().over(Window.partitionBy("review_id").orderBy(rank, "file", F.coalesce("line", F.lit(0)), "seq")) - 1).cast("int"))


# The prompt, with places for what a static analyser knows, the standards and the diff.
KNOWN = """
A static analyzer has ALREADY reported these issues, and they are already in the
review comment:
{issues}
Do NOT repeat them. Report only what the analyzer cannot see (logic errors,
design problems, missing checks, standards violations).
"""
PROMPT = """You are a senior software engineer reviewing a pull request.
{known}

Review ONLY the changes in the unified diff below. Focus on:
- bugs and logic errors
- security vulnerabilities
- refactoring opportunities
- violations of the organization coding standards provided

Organization coding standards:
---
{standards}
---

Unified diff to review:
```diff
{diff}
```

Respond with ONLY a JSON object (no markdown fences) matching this schema:
{{
  "summary": "one paragraph",
  "findings": [
    {{
      "file": "path/to/file",
      "line": 42,
      "category": "bug|security|refactor|style",
      "severity": "info|minor|major|critical",
      "message": "what is wrong",
      "suggestion": "how to fix it"
    }}
  ]
}}

Rules:
- "category" MUST be EXACTLY one of: bug, security, refactor, style. Map any
  other kind of issue to the closest of these four.
- "severity" MUST be EXACTLY one of: info, minor, major, critical.
- "line" must be a single integer or null.
If the change looks good, return an empty findings list."""
NO_STANDARDS = "(none provided)"


def prompt(diff: Column, standards: Column, issues: Column) -> Column:
    """The prompt for a diff, with standards (blank: none) and the lines of known issues (an array, which may be null)."""

    def filled(template: str, **parts: Column) -> Column:
        pieces, rest = [], template
        while "{" in rest.replace("{{", "").replace("}}", ""):
            at = min((rest.index("{%s}" % k), k) for k in parts if "{%s}" % k in rest)
            pieces += [F.lit(rest[: at[0]].replace("{{", "{").replace("}}", "}")), parts[at[1]]]
            rest = rest[at[0] + len(at[1]) + 2 :]
        return F.concat(*pieces, F.lit(rest.replace("{{", "{").replace("}}", "}")))

    listed = F.array_join(F.transform(issues, lambda x: F.concat(F.lit("- "), x)), "\n")
    known = F.when(F.size(issues) > 0, filled(KNOWN, issues=listed)).otherwise("")
    return filled(PROMPT, known=known, standards=F.coalesce(F.nullif(standards, F.lit("")), F.lit(NO_STANDARDS)), diff=F.coalesce(diff, F.lit("")))


def of_rules(findings: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """Rule findings (id, path, line, cwe, name, rule_id, evidence) by the REVIEW schema, by severity, file and line."""
    message = F.concat("name", F.lit(" — this line matches a pattern that is unsafe by definition"), F.coalesce(F.concat(F.lit(" ("), "cwe", F.lit(")")), F.lit("")), F.lit("."))
    rows = findings.select(
        F.col(id_col).alias("review_id"), F.lit(0).alias("seq"), F.col("path").alias("file"), "line", F.lit("security").alias("category"), severity(F.col("cwe")).alias("severity"),
        message.alias("message"), remedy(F.col("cwe")).alias("suggestion"), F.lit("rules").alias("source"), "cwe", "rule_id", F.coalesce("evidence", F.lit("")).alias("evidence"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in ("critical", "major", "minor", "info")]), F.col("severity"))
    number = F.row_number().over(Window.partitionBy("review_id").orderBy(rank, "file", F.coalesce("line", F.lit(0)), "rule_id")) - 1
    return rows.withColumn("seq", number.cast("int"))
