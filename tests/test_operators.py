import pytest
from pyspark.sql import functions as F

from tessera.functions import decision, taxonomy
from tessera.operators import corpus as C
from tessera.operators import findings as N
from tessera.operators import metrics as M
from tessera.operators import review as R

DET = "row_id int, gold string, named array<string>"


def dets(spark, golds, named):
    return spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate(zip(golds, named, strict=True))], DET)


def test_binary(spark):
    r = M.binary_metrics(dets(spark, ["safe", "safe", "safe", "CWE-89", "CWE-79", "CWE-94"], [[], ["CWE-89"], [], ["CWE-89"], ["CWE-502"], []])).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.precision == r.recall == pytest.approx(2 / 3) and r.accuracy == pytest.approx(4 / 6) and r.fire_rate_on_safe == pytest.approx(1 / 3)
    empty = M.binary_metrics(dets(spark, [], [])).first()
    assert empty.n == 0 and empty.f1 == 0.0 and empty.accuracy == 0.0


def test_per_class(spark):
    rows = {r.label: r for r in M.per_class(dets(spark, ["CWE-89", "CWE-89", "safe"], [["CWE-89", "CWE-79"], [], ["CWE-79", "CWE-1337"]])).collect()}
    assert len(rows) == 9 and (rows["CWE-89"].support, rows["CWE-89"].tp, rows["CWE-89"].fn, rows["CWE-89"].fp) == (2, 1, 1, 0)
    assert (rows["CWE-79"].support, rows["CWE-79"].fp) == (0, 2) and "CWE-1337" in rows
    assert M.macro_supported(M.per_class(dets(spark, ["CWE-89", "CWE-94"], [["CWE-89"], ["CWE-94"]]))).first().macro_f1 == 1.0


def test_patched(spark):
    rows = [("CWE-89", ["CWE-89"], []), ("CWE-94", ["CWE-94"], ["CWE-94"]), ("CWE-79", [], ["CWE-79"]), ("CWE-502", ["CWE-502"], ["CWE-89"])]
    r = M.patched(spark.createDataFrame(rows, "gold string, on_vuln array<string>, on_fixed array<string>")).first()
    assert (r.pairs, r.fired_on_fixed, r.only_on_fixed, r.named_gold, r.went_silent) == (4, 3, 1, 3, 2)


def test_taxonomy(spark):
    raw = [" cwe-125 ", "CWE-89", "nan", "", None, "CWE-1", "None"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "c string").select(taxonomy.fold(F.col("c"))).collect()]
    assert got == ["MEMORY-OOB", "CWE-89", None, None, None, None, None]
    paths = {"b/src/a.py": True, "./x.min.js": False, "a/tests/a.py": False, ".py": False, "src/A.GO": True, "`w\\x.c`": True, "README.md": False, "a.py\t2024": True, None: False, "conftest.py": False}
    out = spark.createDataFrame([(p,) for p in paths], "p string").select("p", taxonomy.scannable(F.col("p")).alias("ok"), taxonomy.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: bool(r.ok) for r in out} == paths and {r.p: r.n for r in out}["`w\\x.c`"] == "w/x.c"
    langs = [r[0] for r in spark.createDataFrame([("C",), ("cpp",), ("C++",), ("Python",), ("C#",), ("",)], "l string").select(taxonomy.language_group(F.col("l"))).collect()]
    assert langs == ["c_family"] * 3 + ["non_c"] * 3
    fixed = spark.createDataFrame([("a", "b", True), ("a", "a", True), ("a", " \t", True), ("a", "b", False)], "code string, fixed string, v boolean")
    assert [r[0] for r in fixed.select(taxonomy.has_patch(F.col("v"), F.col("code"), F.col("fixed"))).collect()] == [True, False, False, False]


def corpus(spark, rows):
    return C.labelled(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, split string, code string, is_vulnerable boolean, cwe_id string"))


def test_leaks(spark):
    rows = [("train", f"code {i}", False, None) for i in range(10)] + [("test", f"code {i}", False, None) for i in range(5)] + [("validation", "x" * 4000 + "tail", False, None), ("train", "x" * 4000 + "other", True, "CWE-89"), ("train", "gone", True, "CWE-1")]
    rows = corpus(spark, rows)
    assert rows.count() == 17
    kept = C.drop_leaks(rows)
    assert kept.where("split = 'train'").count() == 5 and kept.where("split <> 'train'").count() == 6
    flags = C.flag_leaks(rows)
    assert flags.where("dup_of_train").count() == 6 and flags.where("split = 'train' AND dup_of_train IS NULL").count() == 11


def test_samples(spark):
    rows = spark.createDataFrame([(i, "safe" if i < 900 else "CWE-89" if i < 990 else "CWE-79") for i in range(1000)], "row_id int, label string")
    got = C.stratified_sample(rows, 100)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"safe": 90, "CWE-89": 9, "CWE-79": 1}
    assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in C.stratified_sample(rows, 100).collect())
    assert C.stratified_sample(rows, 0).count() == C.stratified_sample(rows, 5000).count() == 1000
    assert C.downsample_safe(rows, 4.0, 30).count() == 500 and C.downsample_safe(rows, 1.0, 3000).count() == 1000


def test_decisions(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.0, 1.0, 0.0],)], "p array<double>")
    classes = ["safe", "a", "b"]
    assert [r[0] for r in df.select(decision.decide(F.col("p"), classes)).collect()] == ["a", "a"]
    assert [r[0] for r in df.select(decision.decide(decision.with_offsets(F.col("p"), classes, {"a": 0.5}), classes)).collect()] == ["b", "a"]
    assert df.select(decision.with_offsets(F.col("p"), classes, {"a": 0.0})).first()[0] == [0.2, 0.4, 0.4]
    with pytest.raises(ValueError):
        decision.with_offsets(F.col("p"), classes, {"zzz": 1.0})
    assert df.select(decision.named(decision.ranked(F.col("p"), classes), 0.4)).first()[0] == ["a", "b"]


def test_detectors_merge(spark):
    ml = spark.createDataFrame([(1, "CWE-89", 0.6), (1, "CWE-79", 0.9)], "doc_id int, cwe string, confidence double")
    rules = spark.createDataFrame([(1, 0, "CWE-89", 0.9, 3, "A", "x"), (1, 1, "CWE-94", 0.8, 4, "B", "y"), (1, 2, "CWE-94", 0.5, 9, "C", "z"), (2, 0, "CWE-94", 0.5, 1, "D", "w")], "doc_id int, seq int, cwe string, confidence double, line int, rule_id string, evidence string")
    got = {(r.doc_id, r.cwe): (r.source, r.confidence, r.line) for r in N.merge_detectors(ml, rules).collect()}
    assert got == {(1, "CWE-89"): ("ml+rule", 0.9, 3), (1, "CWE-79"): ("ml", 0.9, None), (1, "CWE-94"): ("ml+rule", 0.8, 9), (2, "CWE-94"): ("rule", 0.5, 1)}


DIFF = """diff --git a/svc/users.py b/svc/users.py
--- a/svc/users.py
+++ b/svc/users.py
@@ -1,3 +1,4 @@
 import db
-old
+new = 1
+++ looks like a header
 end
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/b.py b/b.py
--- a/b.py
+++ b/b.py
@@ -40 +41,2 @@ def f():
 ctx
+added
\\ No newline at end of file
"""


def test_diffs(spark):
    lines = N.parse_diffs(spark.createDataFrame([(1, DIFF), (2, None), (3, "junk\n@@ broken")], "diff_id long, diff string"))
    got = sorted((r.path, r.line, r.text, r.is_added) for r in lines.collect())
    assert got == [("b.py", 41, "ctx", False), ("b.py", 42, "added", True), ("svc/users.py", 1, "import db", False), ("svc/users.py", 2, "new = 1", True), ("svc/users.py", 3, "++ looks like a header", True), ("svc/users.py", 4, "end", False)]
    files = {r.path: r.text for r in N.new_sides(lines).collect()}
    assert files["b.py"] == "\n" * 40 + "ctx\nadded" and len(files) == 2
    assert N.new_sides(lines, max_files=1).count() == 1 and N.new_sides(lines, max_chars=5).count() == 0
    found = spark.createDataFrame([(1, "b.py", 42), (1, "b.py", 41), (1, "b.py", None)], "diff_id long, path string, line int")
    assert N.on_added_lines(found, lines).count() == 1


def finding(seq, file="a.py", line=10, category="security", severity="major", suggestion="", source="llm", message="sql injection", cwe=None):
    return (1, seq, file, line, category, severity, message, suggestion, source, cwe, "R" if source == "rules" else None, "e" if source == "rules" else "")


@pytest.mark.parametrize(
    ("rules", "model", "sources"),
    [
        ([{"line": 10}], [{"line": 12}], ["llm+rules"]),
        ([{"line": 10}], [{"line": 60}], ["rules", "llm"]),
        ([{"line": 10}], [{"line": None}], ["llm+rules"]),
        ([{"line": 10}], [{"line": None, "message": "something else"}], ["rules", "llm"]),
        ([{"line": 10}], [{"line": 10, "category": "bug"}], ["rules", "llm"]),
        ([{"line": 10}, {"line": 11}], [{"line": 10}], ["llm+rules", "rules"]),
        ([{"line": 10}], [{"line": 10, "file": "`b/a.py`"}], ["llm+rules"]),
        ([], [{"line": 1}], ["llm"]),
    ],
)
def test_review_merge(spark, rules, model, sources):
    a = spark.createDataFrame([finding(i, source="rules", cwe="CWE-89", **r) for i, r in enumerate(rules)], N.REVIEW)
    b = spark.createDataFrame([finding(i, severity="critical", suggestion="do", **m) if "severity" not in m else finding(i, **m) for i, m in enumerate(model)], N.REVIEW)
    got = sorted(N.merge_review(a, b).collect(), key=lambda r: r.seq)
    assert [r.source for r in got] == sources
    assert all(r.severity == "critical" and r.suggestion == "do" for r in got if r.source == "llm+rules")


def test_reviews(spark):
    raws = ['{"summary": "s", "findings": []}', '```json\n{"summary": "x", "findings": [{"file": "f", "line": "10-14", "category": "error_handling", "severity": "HIGH", "message": "m"}]}\n```', "not json", 'see {"findings": [{"line": 0, "category": "??", "severity": null}]} end']
    rows = {r.response_id: r for r in R.parse_reviews(spark.createDataFrame(list(enumerate(raws)), "response_id int, raw string")).collect()}
    assert rows[0].ok and rows[0].seq is None and rows[0].summary == "s"
    assert (rows[1].line, rows[1].category, rows[1].severity) == (10, "bug", "major")
    assert not rows[2].ok and (rows[3].line, rows[3].category, rows[3].severity) == (None, "refactor", "minor")


def test_comment(spark):
    reviews = spark.createDataFrame([(1, "sum"), (2, "ok")], "review_id long, summary string")
    found = spark.createDataFrame([finding(1, source="rules", cwe="CWE-89", suggestion="fix"), finding(0, line=None, category="bug", severity="info", message="msg")], N.REVIEW)
    got = {r.review_id: r.comment for r in R.comments(reviews, found).collect()}
    assert got[2] == "## 🤖 AI PR Review\n\nok\n\n✅ No issues found. Looks good!"
    assert got[1].split("\n") == ["## 🤖 AI PR Review", "", "sum", "", "**2 finding(s):**", "", "### 🔵 INFO · bug — `a.py`", "msg", "", "### 🟠 MAJOR · security — `a.py`:10  ·  🔎 static analysis · `R`", "sql injection", "```", "e", "```", "> **Suggestion:** fix", "", R.CAVEAT, "", "---", R.FOOT]


def test_diff_findings_read_every_document(spark, tmp_path):
    from tessera.plans.queries import diff_findings

    spark.createDataFrame([(i, "eval(user_input)\n") for i in range(1, 7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.diff_id for r in diff_findings(spark, str(tmp_path)).collect()} == set(range(1, 7))


def test_webhook_stream(spark, tmp_path):
    import hashlib
    import hmac
    import json

    from tessera.streaming import webhook

    body = json.dumps({"action": "opened", "pull_request": {"number": 7, "url": "u"}, "repository": {"full_name": "o/r"}})
    good = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    events = [(1, "pull_request", good, body), (2, "pull_request", "sha256=0", body), (3, "ping", good, body), (4, "push", good, body), (5, "pull_request", None, body)]
    out = {r.event_id: (r.status, r.outcome) for r in webhook.routed(spark.createDataFrame(events, webhook.EVENT), "k").collect()}
    assert out == {1: (200, "queued"), 2: (401, "rejected"), 3: (200, "pong"), 4: (200, "ignored"), 5: (401, "rejected")}
    assert webhook.routed(spark.createDataFrame(events, webhook.EVENT), "").where("outcome <> 'rejected'").count() == 0
    spark.createDataFrame(events, webhook.EVENT).write.json(f"{tmp_path}/in")
    seen = []
    q = webhook.run(webhook.read_events(spark, f"{tmp_path}/in"), "k", lambda df, _: seen.extend(r.pr for r in df.collect()), f"{tmp_path}/ck")
    q.awaitTermination()
    assert seen == [7]


def test_lines_of_diffs_come_in_small_batches():
    import pyarrow as pa

    text = "--- a/x.py\n+++ b/x.py\n@@ -1,0 +1,%d @@\n" % (N.MAX_ROWS + 5) + "".join(f"+{i}\n" for i in range(N.MAX_ROWS + 5))
    wide = "--- a/y.py\n+++ b/y.py\n@@ -1,0 +1,4 @@\n" + ("+" + "z" * (N.MAX_CHARS // 2) + "\n") * 4
    diffs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([text, None, wide, text])], ["diff_id", "diff"])
    got = list(N.line_batches(iter([diffs])))
    assert max(b.num_rows for b in got) <= N.MAX_ROWS and max(b.nbytes for b in got) <= 2 * N.MAX_CHARS
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [(r[0], r[3], r[4]) for r in rows if r[0] != 3] == [(d, i + 1, str(i)) for d in (1, 4) for i in range(N.MAX_ROWS + 5)] and len(rows) == 2 * N.MAX_ROWS + 14


def test_findings_are_ranked_in_many_partitions(spark):
    rows = spark.range(4000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("seq"))
    got = N.first_per(rows, ["k"], F.col("seq")).select("k", "seq", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.k, r.seq) for r in got) == [(k, k) for k in range(2000)] and len({r.p for r in got}) > N.GATHERED / 2


def test_reviews_are_merged_as_one_by_one(spark):
    import random

    rng = random.Random(7)
    severities, sayings = ["critical", "major", "minor", "info", "odd", None], ["sql injection", "xss", "nothing", None]

    def some(source):
        said = source == "llm"
        row = lambda i, k: (i, k, rng.choice(["a.py", "`b/a.py`", "c.py"]), rng.choice([None, *range(1, 12)]), rng.choice(["security", "security", "bug", None]), rng.choice(severities), rng.choice(sayings), rng.choice(["", " \x1c ", None, f"s{k}"]), source if said else rng.choice(["rules", "rules", "llm"]), None if said else rng.choice(["CWE-89", "CWE-79", None]), None, f"{source}{k}")
        return [row(i, k) for i in range(120) for k in rng.sample(range(30), rng.randrange(7))]

    rules, model = some("rules"), some("llm")
    rank, words = {"critical": 0, "major": 1, "minor": 2, "info": 3}, {"CWE-89": "sql injection", "CWE-79": "xss"}
    plain = lambda p: p.strip("`").removeprefix("b/")
    want = []
    for i in range(120):
        own = [list(r) for r in sorted((r for r in rules if r[0] == i), key=lambda r: r[1])]
        rest = []
        for m in sorted((m for m in model if m[0] == i), key=lambda m: m[1]):
            def fits(r, m=m):
                if plain(r[2]) != plain(m[2]) or r[8] != "rules" or m[4] != "security":
                    return False
                return abs(m[3] - r[3]) <= 3 if None not in (m[3], r[3]) else r[9] in words and words[r[9]] in f"{m[6]} {m[7]}"
            hit = next((r for r in own if fits(r)), None)
            if hit is None:
                rest.append(list(m))
                continue
            hit[8] = "llm+rules"
            hit[7] = m[7] if (m[7] or "").strip() else hit[7]
            hit[5] = m[5] if rank.get(m[5], 9) < rank.get(hit[5], 9) else hit[5]
        want += [(i, k, *r[2:]) for k, r in enumerate(own + rest)]
    merged = N.merge_review(spark.createDataFrame(rules, N.REVIEW), spark.createDataFrame(model, N.REVIEW))
    assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, want)) and any(r[8] == "llm+rules" for r in want)
    # no worker in Python, and one shuffle for all that follows
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_comments_shuffle_findings_once(spark):
    a, b = (spark.createDataFrame([finding(0, source=s, cwe="CWE-89")], N.REVIEW) for s in ("rules", "llm"))
    out = R.comments(spark.createDataFrame([(1, "sum")], "review_id long, summary string"), R.ordered_by_severity(N.merge_review(a, b), taxonomy.severity_rank(F.col("severity"))))
    assert out.first().comment.count("sql injection") == 1
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") <= 2
