"""Structured Streaming forms: corridor decisions and running profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.session import stored

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Arriving event files of a folder as a stream."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def request_key(requests: DataFrame, arrival: str = "ts") -> Column:
    """A digest of all columns of a request but its time of arrival: equal for equal requests only."""
    columns = [F.col(f"`{c}`") for c in sorted(requests.columns) if c != arrival]
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.sha2(F.to_json(F.struct(*columns), options), 256)


def decide_stream(
    requests: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    folder: str,
) -> str:
    """Decide arriving corridor requests, however late; returns the folder of verdicts.

    requests: a stream with package_id, corridor_id, expected_revision and the corridor
    columns; ts, where there is one, is the time of arrival and no part of a request. A
    verdict depends on its request and the snapshot alone, so no state is kept: a repeated
    request, equal in every column, gets the same verdict again, and `answers` shows it once.
    Different requests under one corridor_id, or without any, are answered each: rows of a
    micro-batch are read once and numbered, `decide` sees the number as corridor_id, and verdicts
    carry the request's digest as `request`. How files fall into micro-batches changes nothing.
    Each micro-batch is written to its own folder, so a replayed batch overwrites itself.
    """
    verdicts = f"{folder}/verdicts"

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.select("*", F.unhex(request_key(batch)).alias("request"), F.monotonically_increasing_id().cast("string").alias("_row"))
        rows = stored(named, "requests")
        decided = decide(rows.withColumn("corridor_id", F.col("_row")).drop("request", "_row"))
        own = rows.select("_row", F.col("corridor_id").alias("_id"), "request")
        told = decided.join(own, F.col("corridor_id") == F.col("_row")).withColumn("corridor_id", F.col("_id"))
        told.select(*decided.columns, F.lower(F.hex("request")).alias("request")).write.mode("overwrite").parquet(
            f"{verdicts}/batch_id={batch_id}"
        )

    query = (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return verdicts


def answers(spark: SparkSession, verdicts: str, keyed: bool = False) -> DataFrame:
    """The verdicts of a folder that `decide_stream` filled, one per request; `keyed` keeps its digest."""
    rows = spark.read.parquet(verdicts).drop("batch_id").distinct()
    return rows if keyed else rows.drop("request")


def profile_stream(
    records: DataFrame, folder: str, width: str = "1 day", slide: str = "1 day", lateness: str = "1 hour"
) -> str:
    """Counts and range of arriving values per window and kind; closed windows only.

    records: a stream with ts, kind, value. Late rows beyond the watermark are dropped.
    Returns the folder of finished windows.
    """
    profile = (
        records.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width, slide), "kind")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.expr("value > 0")).alias("positive"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .select("window.start", "window.end", "kind", "records", "positive", "low", "high")
    )
    out = f"{folder}/windows"
    query = (
        profile.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out

