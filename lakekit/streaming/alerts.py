"""Sustained-condition alerts on a stream.

Two stateful steps of one query, both with Spark's own watermark, state and checkpoint. The first
gathers the samples of a series in short time slices; a slice comes out when the watermark has passed
its end, so slices reach the second step in the order of time, whatever order their samples came in.
The second keeps one row per series, the interval that is open, and takes the slices one after the
other. A busy series is spread over tasks by slice where its samples are, and only the few slices of
a batch meet at its state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.metrics import micros
from ..session import settings
from .ingest import start_append

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# the open interval of a series, in microseconds; `told` says that it has been reported as firing
STATE = "start bigint, fired_at bigint, last bigint, told boolean"


def time_slices(sdf: DataFrame, keys: Sequence[str], ts: str, cond: Column | str, delay: str, slice_length: str) -> DataFrame:
    """`keys, slice, samples`: the samples of a slice in order of time, once it is complete.

    Equal timestamps are one sample, which holds when all of them do. Of samples in a row that do
    not hold the first is enough.
    """
    held = cond if isinstance(cond, Column) else F.col(cond)
    timed = sdf.select(*keys, F.col(ts).cast("timestamp").alias("_ts"), F.coalesce(held, F.lit(False)).alias("_c"))
    timed = timed.filter(F.col("_ts").isNotNull()).withWatermark("_ts", delay)
    sample = F.struct(F.unix_micros("_ts").alias("t"), F.col("_c").alias("c"))
    gathered = timed.groupBy(F.window("_ts", slice_length).alias("_w"), *keys).agg(F.sort_array(F.collect_set(sample)).alias("_all"))

    def differs(samples: Column, keep) -> Column:
        return F.filter(samples, lambda x, i: (i == 0) | keep(F.get(samples, i - 1), x))

    # false sorts first, so a true sample of the same time comes behind it and is passed over
    single = gathered.withColumn("_one", differs(F.col("_all"), lambda before, x: before["t"] != x["t"]))
    short = differs(F.col("_one"), lambda before, x: before["c"] | x["c"])
    return single.select(*keys, F.unix_micros("_w.start").alias("_slice"), short.alias("_samples"))


class _Follower(StatefulProcessor):
    """The second step: slices of one series, in order, against the interval that is open."""

    def __init__(self, wait: int, names: list[str]):
        self.wait, self.names = wait, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.open.exists()
        start, fired, last, told = self.open.get() if known else (None, None, None, False)
        # by position: keys may have any names
        slices = sorted(((s, x) for frame in rows for s, x in zip(frame.iloc[:, -2], frame.iloc[:, -1])), key=lambda p: p[0])
        t = np.array([x["t"] for _, samples in slices for x in samples], dtype=np.int64)
        c = np.array([x["c"] for _, samples in slices for x in samples], dtype=bool)
        out = []
        for run in np.split(np.arange(len(t)), np.flatnonzero(c[1:] != c[:-1]) + 1) if len(t) else []:
            if not c[run[0]]:
                if start is not None:
                    out.append((*key, start, last, fired, "closed"))
                start, fired, last, told = None, None, None, False
                continue
            times = t[run]
            start = int(times[0]) if start is None else start
            at = int(np.searchsorted(times, start + self.wait))
            if fired is None and at < len(times):
                fired = int(times[at])
            last = int(times[-1])
        if start is not None:
            if fired is not None and not told:
                told = True
                out.append((*key, start, None, fired, "firing"))
            self.open.update((start, fired, last, told))
        elif known:
            self.open.clear()
        yield pd.DataFrame(out, columns=self.names).astype({c: "Int64" for c in ("start", "end", "fired_at")})

    def close(self) -> None:
        pass


def sustained_alerts(
    sdf: DataFrame,
    key: str | Sequence[str],
    ts: str,
    cond: Column | str,
    hold: str,
    delay: str = "10 minutes",
    slice_length: str = "1 second",
) -> DataFrame:
    """Stream of alert rows: `key, start, end, fired_at, status`, to be written in append mode by a
    session whose state store is RocksDB.

    `status` is `firing` once per interval, in the batch in which the hold time is reached while the
    interval goes on, and `closed` when a sample that does not hold ends it. Samples later than the
    watermark, `delay` behind the newest time, are dropped. `fired_at` is the first sample at least
    `hold` after the start; an interval that ends before has none.
    """
    keys = [key] if isinstance(key, str) else list(key)
    slices = time_slices(sdf, keys, ts, cond, delay, slice_length)
    names = [*keys, "start", "end", "fired_at", "status"]
    out = StructType([*[sdf.schema[k] for k in keys]]).add("start", "long").add("end", "long").add("fired_at", "long").add("status", "string")
    step = _Follower(micros(hold), names)
    found = slices.groupBy(*keys).transformWithStateInPandas(step, out, "Append", "None")
    times = {c: F.timestamp_micros(c) for c in ("start", "end", "fired_at")}
    return found.withColumns(times)


def stream_sustained(
    sdf: DataFrame,
    key: str | Sequence[str],
    ts: str,
    cond: Column | str,
    hold: str,
    path: str,
    delay: str = "10 minutes",
    slice_length: str = "1 second",
) -> DataFrame:
    """Run the alert stream over what is available; returns all alert rows under `path` so far.

    The checkpoint below `path` carries watermark and state over restarts; a batch that is run
    again replaces its own files.
    """
    alerts = sustained_alerts(sdf, key, ts, cond, hold, delay, slice_length)
    # the state of arbitrary operators needs this store; the query keeps the settings it is started with
    with settings(sdf.sparkSession, {STORE: ROCKSDB}):
        query = start_append(alerts, f"{path}/alerts", f"{path}/checkpoint")
    query.awaitTermination()
    return sdf.sparkSession.read.schema(alerts.schema).parquet(f"{path}/alerts")
