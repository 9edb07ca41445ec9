"""Queued webhook events through all stages: diff, scan, model's answer, merged review, comment.

Diffs and answers are tables that others fill, by event; what is missing or
broken in one event costs that stage of that event only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.operators import findings as N
from tessera.operators import review as R
from tessera.plans.reviews import scan_diffs


def reviewed(events: DataFrame, diffs: DataFrame, answers: DataFrame, scan: Callable[[DataFrame], DataFrame] = scan_diffs) -> DataFrame:
    """(event_id, comment, stage) of queued events; `diffs` (event_id, diff), `answers` (event_id, raw).

    stage is `done`, or the stage at which the event stays behind: without a
    diff `fetch_diff`, without a readable answer `review`. A failing scan
    leaves the model's findings.
    """
    rows = events.select("event_id").join(diffs, "event_id", "left").join(answers, "event_id", "left")
    with_diff = rows.where(F.col("diff").isNotNull())
    own = scan(with_diff.select(F.col("event_id").alias("diff_id"), "diff"))
    rules = R.of_rules(own)
    said = R.parse_reviews(with_diff.where(F.col("raw").isNotNull()).select(F.col("event_id").alias("response_id"), "raw"))
    said = said.withColumnRenamed("response_id", "review_id")
    read = said.where("ok").select("review_id", "summary").distinct()
    none = F.lit(None).cast("string")
    model = said.where("ok AND seq IS NOT NULL").select("review_id", "seq", "file", "line", "category", "severity", "message", "suggestion", F.lit("llm").alias("source"), none.alias("cwe"), none.alias("rule_id"), F.lit("").alias("evidence"))
    # rule findings come first, by gravity, then what only the model said
    merged = N.merge_review(rules.join(read.select("review_id"), "review_id", "left_semi").select(model.columns), model)
    comments = R.comments(read, merged).withColumnRenamed("review_id", "event_id")
    stage = F.when(F.col("diff").isNull(), "fetch_diff").when(F.col("comment").isNull(), "review").otherwise("done")
    return rows.select("event_id", "diff").join(comments, "event_id", "left").select("event_id", "comment", stage.alias("stage"))


def guarded(scan: Callable[[DataFrame], DataFrame], note: Callable[[Exception], None]) -> Callable[[DataFrame], DataFrame]:
    """A scan that is run at once and whose failure is noted and gives no findings."""

    def safe(diffs: DataFrame) -> DataFrame:
        try:
            found = scan(diffs).persist()
            found.count()
            return found
        except Exception as e:  # noqa: BLE001 - a scan must never cost a review
            note(e)
            kind = f"diff_id {diffs.schema['diff_id'].dataType.simpleString()}, path string, line int, cwe string, name string, rule_id string, confidence double, evidence string"
            return diffs.sparkSession.createDataFrame([], kind)

    return safe


class Progress(StreamingQueryListener):
    """Calls back with the number and the rows of each micro-batch."""

    def __init__(self, call: Callable[[int, int], None]):
        self.call = call

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.call(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def handler(diffs: Callable[[DataFrame], DataFrame], answers: Callable[[DataFrame], DataFrame], post: Callable[[DataFrame, int], None], note: Callable[[str, Exception], None]) -> Callable[[DataFrame, int], None]:
    """What webhook.run calls for each micro-batch: stages that fail are noted by name, and the stream goes on."""

    def handle(batch: DataFrame, number: int) -> None:
        stage = "fetch_diff"
        try:
            events = batch.persist()
            texts = diffs(events)
            stage = "review"
            said = answers(events)
            out = reviewed(events, texts, said, guarded(scan_diffs, lambda e: note("scan", e)))
            stage = "post"
            post(out, number)
        except Exception as e:  # noqa: BLE001 - one batch must not end the stream
            note(stage, e)
        finally:
            batch.unpersist()

    return handle
