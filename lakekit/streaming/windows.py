"""Windowed rates on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import micros


def stream_rate(
    sdf: DataFrame,
    key: str | Sequence[str],
    ts: str,
    value: str,
    window: str = "5 minutes",
    slide: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Per key and window: samples, total of `value` and total per second.

    `value` is an amount per sample, not a running counter. Windows are tumbling, or sliding by
    `slide`; rows later than the watermark are dropped. In append mode a window is emitted once
    the watermark has passed its end, so the last windows of a finished input stay open.

    Samples combine per window before the shuffle and the state is one row per key and window.
    The same function runs on a batch DataFrame, where the watermark has no effect.
    """
    keys = [key] if isinstance(key, str) else list(key)
    timed = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    total = F.sum(value)
    return (
        timed.groupBy(frame.alias("w"), *keys)
        .agg(F.count(value).alias("samples"), total.alias("total"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *keys,
            "samples",
            "total",
            (F.col("total") / F.lit(micros(window) / 1e6)).alias("rate"),
        )
    )
