import hashlib
import hmac
import json
import time

from tessera.streaming import events, webhook

DIFF = "diff --git a/x.js b/x.js\n--- a/x.js\n+++ b/x.js\n@@ -0,0 +1,2 @@\n+var q = f();\n+el.innerHTML = q;"
ANSWER = json.dumps({"summary": "s", "findings": [{"file": "x.js", "line": 2, "category": "security", "severity": "critical", "message": "XSS", "suggestion": "escape"}, {"file": "x.js", "line": 1, "category": "style", "severity": "info", "message": "name"}]})


def test_every_stage_by_itself(spark):
    queued = spark.createDataFrame([(1,), (2,), (3,), (4,)], "event_id long")
    diffs = spark.createDataFrame([(1, DIFF), (2, DIFF), (3, DIFF)], "event_id long, diff string")
    answers = spark.createDataFrame([(1, ANSWER), (2, "{bad"), (4, ANSWER)], "event_id long, raw string")
    rows = {r.event_id: r for r in events.reviewed(queued, diffs, answers).collect()}
    assert {i: r.stage for i, r in rows.items()} == {1: "done", 2: "review", 3: "review", 4: "fetch_diff"}
    assert "**2 finding(s):**" in rows[1].comment and "🔎🤖" in rows[1].comment and "CRITICAL · security — `x.js`:2" in rows[1].comment and rows[4].comment is None

    noted = []

    def broken(_):
        raise RuntimeError("scan")

    rows = {r.event_id: r for r in events.reviewed(queued, diffs, answers, events.guarded(broken, noted.append)).collect()}
    assert len(noted) == 1 and rows[1].stage == "done" and "🔎" not in rows[1].comment


def test_stream_from_event_to_comment(spark, tmp_path):
    body = json.dumps({"action": "opened", "pull_request": {"number": 7, "url": "u"}, "repository": {"full_name": "r"}})
    sign = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "e.json", "w") as f:
        for i, s in ((1, sign), (2, "sha256=00")):
            f.write(json.dumps({"event_id": i, "event": "pull_request", "signature": s, "body": body}) + "\n")
    posted, noted = [], []
    diffs = lambda e: spark.createDataFrame([(1, DIFF)], "event_id long, diff string")
    answers = lambda e: spark.createDataFrame([(1, ANSWER)], "event_id long, raw string")
    handle = events.handler(diffs, answers, lambda df, n: posted.extend(df.collect()), lambda stage, e: noted.append((stage, e)))
    seen = []
    progress = events.Progress(lambda number, n: seen.append((number, n)))
    spark.streams.addListener(progress)
    webhook.run(webhook.read_events(spark, str(tmp_path / "in")), "k", handle, str(tmp_path / "checkpoint")).awaitTermination(120)
    for _ in range(100):
        if seen:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert seen[0] == (0, 2)
    assert [(r.event_id, r.stage) for r in posted] == [(1, "done")] and not noted

    def fails(e):
        raise ValueError("no network")

    events.handler(fails, answers, lambda df, n: None, lambda stage, e: noted.append((stage, str(e))))(spark.createDataFrame([(1,)], "event_id long"), 0)
    assert noted == [("fetch_diff", "no network")]
