"""Spark event logs as tables of jobs, stages, tasks and SQL executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The event fields the summaries use, in the log's own spelling.
EVENT_SCHEMA = """
    `Event` string,
    `Job ID` bigint,
    `Submission Time` bigint,
    `Completion Time` bigint,
    `Stage IDs` array<bigint>,
    `Job Result` struct<`Result`: string>,
    `Stage ID` bigint,
    `Stage Attempt ID` bigint,
    `Stage Info` struct<`Stage ID`: bigint, `Stage Attempt ID`: bigint, `Stage Name`: string,
        `Number of Tasks`: bigint, `Submission Time`: bigint, `Completion Time`: bigint,
        `Failure Reason`: string>,
    `Task Info` struct<`Task ID`: bigint, `Attempt`: bigint, `Launch Time`: bigint,
        `Finish Time`: bigint, `Failed`: boolean, `Killed`: boolean, `Executor ID`: string>,
    `Task Metrics` struct<`Executor Run Time`: bigint, `JVM GC Time`: bigint,
        `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
        `Input Metrics`: struct<`Bytes Read`: bigint>,
        `Output Metrics`: struct<`Bytes Written`: bigint>,
        `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>,
    `executionId` bigint,
    `description` string,
    `time` bigint
"""


def read_event_logs(spark: SparkSession, path: str, pattern: str = "events_*") -> DataFrame:
    """All events below `path`, one row each, with the log's file path as `app_log`."""
    return (
        spark.read.schema(EVENT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(path)
        .withColumn("app_log", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]+$", ""))
    )


def _millis(col):
    return F.timestamp_millis(col)


def jobs(events: DataFrame) -> DataFrame:
    """One row per job: start, end, result (NULL while running), number of stages."""
    wanted = events.filter(F.col("Event").isin("SparkListenerJobStart", "SparkListenerJobEnd"))
    return wanted.groupBy("app_log", F.col("Job ID").alias("job_id")).agg(
        _millis(F.max("Submission Time")).alias("started_at"),
        _millis(F.max("Completion Time")).alias("ended_at"),
        F.max("Job Result.Result").alias("result"),
        F.max(F.size("Stage IDs")).alias("stages"),
    )


def stages(events: DataFrame) -> DataFrame:
    """One row per stage attempt; `ended_at` is NULL while it runs."""
    info = F.col("Stage Info")
    wanted = events.filter(
        F.col("Event").isin("SparkListenerStageSubmitted", "SparkListenerStageCompleted")
    )
    return wanted.groupBy(
        "app_log",
        info["Stage ID"].alias("stage_id"),
        info["Stage Attempt ID"].alias("attempt"),
    ).agg(
        F.max(info["Stage Name"]).alias("name"),
        F.max(info["Number of Tasks"]).alias("num_tasks"),
        _millis(F.max(info["Submission Time"])).alias("started_at"),
        _millis(F.max(info["Completion Time"])).alias("ended_at"),
        F.max(info["Failure Reason"]).alias("failure"),
    )


def tasks(events: DataFrame) -> DataFrame:
    """One row per finished task."""
    info, metrics = F.col("Task Info"), F.col("Task Metrics")
    return events.filter(F.col("Event") == "SparkListenerTaskEnd").select(
        "app_log",
        F.col("Stage ID").alias("stage_id"),
        F.col("Stage Attempt ID").alias("attempt"),
        info["Task ID"].alias("task_id"),
        info["Executor ID"].alias("executor_id"),
        info["Failed"].alias("failed"),
        (info["Finish Time"] - info["Launch Time"]).alias("duration_ms"),
        metrics["Executor Run Time"].alias("run_ms"),
        metrics["JVM GC Time"].alias("gc_ms"),
        metrics["Input Metrics"]["Bytes Read"].alias("input_bytes"),
        metrics["Output Metrics"]["Bytes Written"].alias("output_bytes"),
        (
            metrics["Shuffle Read Metrics"]["Remote Bytes Read"]
            + metrics["Shuffle Read Metrics"]["Local Bytes Read"]
        ).alias("shuffle_read_bytes"),
        metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("shuffle_write_bytes"),
        (metrics["Memory Bytes Spilled"] + metrics["Disk Bytes Spilled"]).alias("spilled_bytes"),
    )


def sql_executions(events: DataFrame) -> DataFrame:
    """One row per SQL execution; `ended_at` is NULL while it runs."""
    start = F.col("Event").endswith(F.lit("SparkListenerSQLExecutionStart"))
    end = F.col("Event").endswith(F.lit("SparkListenerSQLExecutionEnd"))
    return (
        events.filter(start | end)
        .groupBy("app_log", F.col("executionId").alias("execution_id"))
        .agg(
            F.max("description").alias("description"),
            _millis(F.max(F.when(start, F.col("time")))).alias("started_at"),
            _millis(F.max(F.when(end, F.col("time")))).alias("ended_at"),
        )
    )
