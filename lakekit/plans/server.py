"""Panels of the query server's dashboard, from its metric samples `(ts, metric, labels, value)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band
from ..operators.metrics import MB, SERIES, by_series, counter_rate, current_state, scale, select_series

# Job label, states, steps, and the metric name patterns of every panel.
JOB = "spark-connect"
STATES = {0: "DOWN", 1: "UP"}
STATUS_STEPS = [(None, "red"), (1, "green")]
DRIVER = "metrics_spark_.*_driver_"
NEWEST = {
    "Heap Memory": DRIVER + "ExecutorMetrics_JVMHeapMemory_Value",
    "Active Jobs": DRIVER + "DAGScheduler_job_activeJobs_Value",
    "Memory Used": DRIVER + "BlockManager_memory_memUsed_MB_Value",
    "Minor GC": DRIVER + "ExecutorMetrics_MinorGCCount_Value",
    "Major GC": DRIVER + "ExecutorMetrics_MajorGCCount_Value",
}
IN_MB = ["Memory Used"]
OVER_TIME = {
    "JVM Memory": {
        "Heap Used": DRIVER + "ExecutorMetrics_JVMHeapMemory_Value",
        "Off-Heap": DRIVER + "ExecutorMetrics_JVMOffHeapMemory_Value",
    },
    "Listener Events": {
        "Events Posted": DRIVER + "LiveListenerBus_numEventsPosted_Count",
        "Dropped Events": DRIVER + "LiveListenerBus_queue_appStatus_numDroppedEvents_Count",
    },
    "Stages": {
        "Running Stages": DRIVER + "DAGScheduler_stage_runningStages_Value",
        "Waiting Stages": DRIVER + "DAGScheduler_stage_waitingStages_Value",
        "Failed Stages": DRIVER + "DAGScheduler_stage_failedStages_Value",
    },
}
RATES = {
    "GC Time Rate": {
        "Minor GC Time": DRIVER + "ExecutorMetrics_MinorGCTime_Value",
        "Major GC Time": DRIVER + "ExecutorMetrics_MajorGCTime_Value",
    }
}
RATE_WINDOW = "5 minutes"


def _labelled(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Samples that match one of the patterns, with its label; others are left out."""
    label = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        label = F.when(F.col("metric").rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(label)
    return samples.withColumn("label", label).filter(F.col("label").isNotNull())


def server_panels(samples: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per panel: newest values by series, and series over time as `(ts, metric, labels, label, value)`.

    A series is a metric with one set of labels: two instances of a server are never mixed.
    """
    up = select_series(samples, name="up", labels={"job": JOB})
    panels = {
        "Status": current_state(by_series(up), SERIES, states=STATES).withColumn(
            "colour", band(F.col("value"), STATUS_STEPS)
        )
    }
    for title, pattern in NEWEST.items():
        newest = current_state(by_series(select_series(samples, name_regex=pattern)), SERIES)
        panels[title] = scale(newest, MB) if title in IN_MB else newest
    for title, patterns in OVER_TIME.items():
        panels[title] = by_series(_labelled(samples, patterns)).select("ts", *SERIES, "label", "value")
    for title, patterns in RATES.items():
        rates = counter_rate(by_series(_labelled(samples, patterns)), [*SERIES, "label"], "ts", "value", RATE_WINDOW)
        panels[title] = rates.select("ts", *SERIES, "label", F.col("rate").alias("value"))
    return panels

