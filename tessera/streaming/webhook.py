"""Webhook events: verifying, routing and reading them, on a stream or a table."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Actions that start a review, and the shape of an event's body.
REVIEWED = ("opened", "synchronize", "reopened")
BODY = "action string, pull_request struct<number:bigint,url:string>, repository struct<full_name:string>"
EVENT = "event_id long, event string, signature string, body string"


def signed(secret: str) -> Callable:
    """A column function: whether a signature is the body's HMAC. Without a secret nothing is."""
    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        def good(b, s) -> bool:
            if not secret or not s or not s.startswith("sha256="):
                return False
            return hmac.compare_digest("sha256=" + hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest(), s)

        return pd.Series([good(b, s) for b, s in zip(body, signature, strict=True)], dtype=bool)

    return check


def routed(events: DataFrame, secret: str) -> DataFrame:
    """Adds status (401 or 200), outcome (rejected, pong, ignored or queued), and the pull request's number, address and repository."""
    parsed = events.withColumn("_ok", signed(secret)("body", "signature")).withColumn("_b", F.from_json("body", BODY))
    outcome = (
        F.when(~F.col("_ok"), "rejected").when(F.col("event") == "ping", "pong")
        .when((F.coalesce("event", F.lit("")) != "pull_request") | ~F.coalesce(F.col("_b.action").isin(*REVIEWED), F.lit(False)), "ignored").otherwise("queued")
    )
    return parsed.select("event_id", F.when(F.col("_ok"), 200).otherwise(401).alias("status"), outcome.alias("outcome"), F.col("_b.action").alias("action"), F.col("_b.pull_request.number").alias("pr"), F.col("_b.pull_request.url").alias("url"), F.col("_b.repository.full_name").alias("repo"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events from JSON files."""
    return spark.readStream.schema(EVENT).json(folder)


def run(events: DataFrame, secret: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream: each micro-batch of queued events goes to `handle`; checkpoints make that at least once."""
    queued = routed(events, secret).where("outcome = 'queued'")
    return queued.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
