"""Streaming of webhook events: ready events are deduplicated by id within a watermark and appended to a job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The names an event id may come under, in order.
ID_ALIASES = ["event_id", "eventId", "id", "hook_id", "delivery_id"]


def event_id(df: DataFrame) -> Column:
    """The first id an event has, as text; null without one."""
    found = [F.col(c).cast("string") for c in ID_ALIASES if c in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def ready(df: DataFrame) -> DataFrame:
    """Events whose status says success, or whose type is itself a success, and that name a plan."""
    said = F.lower(F.coalesce("status", F.lit(""))).contains("success") | F.lower(F.coalesce("event_type", F.lit(""))).contains("success")
    return df.where(said & F.col("plan_id").isNotNull())


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream (or table) of ready events, each id once; events without an id all pass. On a stream ids are forgotten behind the
    watermark, so state stays bounded."""
    keyed = ready(events).withColumn("_id", event_id(events))
    with_id, without = keyed.where("_id is not null"), keyed.where("_id is null")
    if events.isStreaming:
        with_id = with_id.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_id"])
        without = without.withWatermark("ts", delay)
    else:
        with_id = with_id.dropDuplicates(["_id"])
    return with_id.unionByName(without).drop("_id")


def to_jobs(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Starts the stream: deduplicated ready events, appended to a Parquet job table as pending jobs."""
    jobs = deduplicated(events, delay).withColumn("state", F.lit("pending"))
    return jobs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def job_states(jobs: DataFrame) -> DataFrame:
    """Latest state, attempts and failures of each job, from a table or (in update mode) a stream."""
    return jobs.groupBy("job_id").agg(F.max_by("state", "ts").alias("state"), F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("state") == "failed", 1).otherwise(0)).alias("failures"))
