"""Metric samples `(ts, metric, labels, value)`: selection, rates, alerts, panels, retention.

A series may hold a third of all samples. Nothing here sorts a whole series in one task: rates and
alert intervals are computed per time slice of a series and carried across slices through tables
that have one row per slice.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import map_values
from .skew import heavy_cells, with_slice

MB = 1048576
# what tells one series from another
SERIES = ("metric", "labels")

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def micros(duration: str) -> int:
    """`'5 minutes'` to microseconds."""
    found = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", duration)
    if not found or int(found.group(1)) == 0:
        raise ValueError(f"bad duration {duration!r}")
    return int(found.group(1)) * _UNITS[found.group(2)] * 1_000_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _as_micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def select_series(
    df: DataFrame, name: str | None = None, name_regex: str | None = None, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Series by name, by anchored name pattern and by label equality."""
    if name is not None:
        df = df.filter(F.col("metric") == name)
    if name_regex is not None:
        df = df.filter(F.col("metric").rlike(f"^(?:{name_regex})$"))
    for label, value in (labels or {}).items():
        df = df.filter(F.try_element_at("labels", F.lit(label)) == value)
    return df


def scale(df: DataFrame, factor: float = MB, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) * F.lit(factor))


def counter_rate(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    value: str,
    window: str = "5 minutes",
    order: str | None = None,
    slice_length: str = "1 hour",
) -> DataFrame:
    """Per-second rate of a counter over `(t - window, t]` at every sample: `key, ts, value, rate`.

    A decrease is a reset: the new value counts as the increment. The rate is the increase between
    the first and the last sample of the window divided by the time between them, without
    extrapolation, and NULL for fewer than two samples. Samples without a value are ignored; equal
    timestamps collapse to the last by `order` (by default to the largest value), and they do so
    before any row is moved to its series.

    A series is cut into slices of `slice_length`, busy ones into narrower ones of at least the
    window, but for the last slice of a cell, which gets what is left. Every slice also gets the
    samples of the window before it, which is all a rate in that slice can look at, so slices are
    independent. Within a slice the increase is a difference of
    running totals; the first sample of each window is found by sorting the window starts in among
    the samples. Both are linear, however many samples a window holds.
    """
    keys = _keys(key)
    span = micros(window)
    length = max(micros(slice_length), 4 * span)
    kept = df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        F.struct(*keys).alias("_key"),
        _as_micros(ts).alias("_t"),
        F.col(value).alias("_v"),
        *([F.col(order).alias("_o")] if order else []),
    )
    last = F.max(F.struct("_o", "_v"))["_v"] if order else F.max("_v")
    samples = kept.groupBy("_key", "_t").agg(last.alias("_v"))
    heavy = heavy_cells(kept, length, span)
    placed = with_slice(samples, heavy, length, F.col("_t"), "_own")
    end = F.col("_t") + F.lit(span - 1)
    placed = with_slice(placed, heavy, length, end, "_later")
    # the narrow last slice of a cell may lie between the two
    cell_end = (F.floor(F.col("_t") / F.lit(length)) + 1) * F.lit(length) - 1
    placed = with_slice(placed, heavy, length, F.least(end, cell_end), "_between")
    placed = placed.withColumn("_slice", F.explode(F.array_distinct(F.array("_own", "_between", "_later"))))

    upward = Window.partitionBy("_key", "_slice").orderBy("_t")
    before = F.lag("_v").over(upward)
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col("_v") >= before, F.col("_v") - before).otherwise(F.col("_v"))
    so_far = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        placed.withColumn("_step", step)
        .withColumn("_total", F.sum("_step").over(so_far))
        .withColumn("_number", F.row_number().over(upward))
    )
    # every sample again as the start of its window; going down in time, the sample met last
    # before a window start is the first one inside the window
    own_only = F.col("_slice") == F.col("_own")
    entries = F.when(
        own_only, F.array(F.col("_t"), F.col("_t") - F.lit(span - 1))
    ).otherwise(F.array(F.col("_t")))
    points = totals.select("*", F.posexplode(entries).alias("_start", "_at"))
    downward = Window.partitionBy("_key", "_slice").orderBy(F.col("_at").desc(), F.col("_start").asc())
    met = downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = F.when(F.col("_start") == 0, F.struct("_t", "_total", "_number"))
    found = points.withColumn("_first", F.last(sample, ignorenulls=True).over(met)).filter(F.col("_start") == 1)
    seconds = (F.col("_t") - F.col("_first._t")) / F.lit(1e6)
    rate = F.when(F.col("_number") > F.col("_first._number"), (F.col("_total") - F.col("_first._total")) / seconds)
    return found.select(
        *[F.col(f"_key.{k}").alias(k) for k in keys],
        F.timestamp_micros("_t").cast(df.schema[ts].dataType).alias(ts),
        F.col("_v").alias(value),
        rate.alias("rate"),
    )


def sustained(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    cond: Column | str,
    hold: str | Column,
    slice_length: str = "1 day",
) -> DataFrame:
    """Intervals in which a condition holds without a break: `key, start, end, fired_at, samples, open`.

    `fired_at` is the first sample at least `hold` after the start, NULL when the interval ends
    before; `hold` is a duration, or a column of seconds that is constant per series. A false or
    NULL condition ends an interval. Samples of a series with equal timestamps count as one, which
    holds when all of them do; they are combined before any row is moved to its series. `open`
    marks an interval that reaches the last sample of its series.

    A series is cut into slices of `slice_length`, busy ones into narrower ones. Runs inside a
    slice are found per slice; one row per slice then tells which run continues into the next
    slice, and the rows are grouped by the true start of their run.
    """
    keys = _keys(key)
    held = cond if isinstance(cond, Column) else F.col(cond)
    wait = hold.cast("bigint") * F.lit(1_000_000) if isinstance(hold, Column) else F.lit(micros(hold))
    length = micros(slice_length)
    rows = df.filter(F.col(ts).isNotNull()).select(
        F.struct(F.struct(*keys).alias("k"), wait.cast("bigint").alias("wait")).alias("_key"),
        _as_micros(ts).alias("_t"),
        F.coalesce(held, F.lit(False)).alias("_c"),
    )
    samples = rows.groupBy("_key", "_t").agg(F.min("_c").alias("_c"))
    placed = with_slice(samples, heavy_cells(rows, length, 1_000_000), length, F.col("_t"), "_slice")
    in_slice = Window.partitionBy("_key", "_slice").orderBy("_t")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("_c").over(in_slice)
    runs = (
        placed.withColumn("_turn", before.isNull() | (before != F.col("_c")))
        .withColumn("_run", F.sum(F.col("_turn").cast("int")).over(so_far))
        .withColumn("_from", F.max(F.when(F.col("_turn"), F.col("_t"))).over(so_far))
    )
    # partitioned like the window above, so this needs no further shuffle
    slices = runs.groupBy("_key", "_slice").agg(
        F.min("_t").alias("_first"),
        F.bool_and("_c").alias("_whole"),
        F.max(F.struct("_run", "_c", "_from")).alias("_last"),
    )
    ends_in = F.when(F.col("_last._c"), F.col("_last._from"))
    by_slice = Window.partitionBy("_key").orderBy("_slice")
    counted = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.sum((~F.col("_whole")).cast("int")).over(counted)
    in_group = Window.partitionBy("_key", "_group").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # a wholly true slice continues what the last other slice left open, or starts a run
    inherited = F.coalesce(
        F.max(F.when(~F.col("_whole"), ends_in)).over(in_group),
        F.min(F.when(F.col("_whole"), F.col("_first"))).over(in_group),
    )
    carried = (
        slices.withColumn("_group", group)
        .withColumn("_open_from", F.when(F.col("_whole"), inherited).otherwise(ends_in))
        .withColumn("_carry", F.lag("_open_from").over(by_slice))
        .withColumn("_newest", F.lead("_slice").over(by_slice).isNull())
        .select("_key", "_slice", "_carry", F.when(F.col("_newest"), F.col("_open_from")).alias("_still"))
    )
    start = F.when((F.col("_run") == 1) & F.col("_carry").isNotNull(), F.col("_carry")).otherwise(F.col("_from"))
    started = (
        runs.filter("_c")
        .select("_key", "_slice", "_t", "_run", "_from")
        .join(carried, ["_key", "_slice"])
        .withColumn("_start", start)
    )
    fired = F.min(F.when(F.col("_t") - F.col("_start") >= F.col("_key.wait"), F.col("_t")))
    return (
        started.groupBy("_key", "_start")
        .agg(
            F.max("_t").alias("_end"),
            fired.alias("_fired"),
            F.count("*").alias("samples"),
            F.max(F.coalesce(F.col("_still") == F.col("_start"), F.lit(False))).alias("open"),
        )
        .select(
            *[F.col(f"_key.k.{k}").alias(k) for k in keys],
            F.timestamp_micros("_start").alias("start"),
            F.timestamp_micros("_end").alias("end"),
            F.timestamp_micros("_fired").alias("fired_at"),
            "samples",
            "open",
        )
    )


# The three alert rules; a NULL job means any job. No listener events
# is a stand-in for no executors, and no proof of it.
ALERT_RULES = [
    ("SparkConnectDown", "up", "spark-connect", "equals", 0.0, 120, "critical"),
    ("SparkConnectHighHeapUsage", "metrics_spark_connect_server_driver_jvm_heap_usage", None, "above", 0.9, 300, "warning"),
    (
        "SparkConnectNoExecutors",
        "metrics_spark_connect_server_driver_LiveListenerBus_numEventsPosted",
        None,
        "equals",
        0.0,
        600,
        "warning",
    ),
]
RULE_SCHEMA = (
    "alert string, metric string, job string, op string, threshold double, hold_seconds int, severity string"
)


def label_text(labels: Column | str) -> Column:
    """A label set as text, `name=value` by name: equal for equal sets whatever their order; NULL is empty."""
    entries = F.array_sort(F.map_entries(labels))
    parts = F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def by_series(samples: DataFrame) -> DataFrame:
    """Samples with their label set as text: metric and `labels` together name a series."""
    return samples.withColumn("labels", label_text("labels"))


def evaluate_rules(
    samples: DataFrame, rules: DataFrame, series: Sequence[str] = SERIES, ts: str = "ts", slice_length: str = "1 day"
) -> DataFrame:
    """Fired alerts of all rules over all series: `alert, severity, <series>, start, end, fired_at`.

    A series is a metric with one set of labels; `labels` is that set as text.

    Rules are joined to samples by metric name and, where a rule names one, job label; one pass for all rules whatever their hold times.
    """
    holds = (
        F.when(F.col("op") == "equals", F.col("value") == F.col("threshold"))
        .when(F.col("op") == "above", F.col("value") > F.col("threshold"))
        .when(F.col("op") == "below", F.col("value") < F.col("threshold"))
    )
    named = rules.withColumnsRenamed({"metric": "_metric", "job": "_job"})
    same_job = F.col("_job").isNull() | (F.try_element_at("labels", F.lit("job")) == F.col("_job"))
    judged = by_series(samples.join(named, (F.col("metric") == F.col("_metric")) & same_job))
    runs = sustained(judged, ["alert", "severity", *series], ts, holds, F.col("hold_seconds"), slice_length)
    return runs.filter(F.col("fired_at").isNotNull()).select("alert", "severity", *series, "start", "end", "fired_at")


def current_state(
    df: DataFrame, key: str | Sequence[str], ts: str = "ts", value: str = "value", states: Mapping | None = None
) -> DataFrame:
    """Newest sample per series with its mapped state; on a tie the larger value."""
    newest = df.groupBy(*_keys(key)).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).alias("_n"))
    out = newest.select(*_keys(key), F.col("_n.t").alias(ts), F.col("_n.v").alias(value))
    return out.withColumn("state", map_values(F.col(value).cast("int"), states)) if states else out


def panel(
    df: DataFrame, labels: Mapping[str, str] | Sequence[str], ts: str = "ts", label: str = "label", value: str = "value"
) -> DataFrame:
    """One row per time, one column per label; the larger value where two samples share a cell.

    The labels are given, so the pivot needs no pass to find them.
    """
    names = dict(labels) if isinstance(labels, Mapping) else {v: v for v in labels}
    cells = [F.max(F.when(F.col(label) == v, F.col(value))).alias(n) for v, n in names.items()]
    return df.filter(F.col(label).isin(list(names))).groupBy(ts).agg(*cells)


def retain(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    now,
    max_age: str | None = None,
    max_n: int | None = None,
    tie: Sequence[str] = (),
    slice_length: str = "1 day",
) -> DataFrame:
    """Rows not older than `max_age` and among the newest `max_n` of their key; the newest always stays.

    Rows are counted per time slice first, busy slices being narrower. A slice that lies wholly
    within or beyond the limit is kept or dropped by its count; only rows of the one slice per key
    in which the limit falls are ranked. `tie` orders equal timestamps. Rows without a timestamp
    count as the oldest.
    """
    keys = _keys(key)
    limit = max_n if max_n is not None else 2**62
    if limit < 1:
        raise ValueError("max_n must be at least 1")
    length = micros(slice_length)
    oldest = -(2**60)
    cutoff = F.lit(oldest - 1)
    if max_age is not None:
        cutoff = F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(micros(max_age))
    timed = df.withColumn("_key", F.struct(*keys)).withColumn("_t", F.coalesce(_as_micros(ts), F.lit(oldest)))
    heavy = heavy_cells(timed.select("_key", "_t"), length, 1_000_000)
    staged = with_slice(timed, heavy, length, F.col("_t"), "_slice")
    sizes = staged.groupBy("_key", "_slice").agg(F.count("*").alias("_n"), F.max("_t").alias("_top"))
    newest_first = Window.partitionBy("_key").orderBy(F.col("_slice").desc())
    running = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sizes.withColumn("_newer", F.sum("_n").over(running) - F.col("_n")).filter(F.col("_newer") < limit)
    joined = staged.join(reached, ["_key", "_slice"])
    fits = F.col("_newer") + F.col("_n") <= limit
    only_newest = (F.col("_newer") == 0) & (F.col("_top") <= cutoff)
    whole = joined.filter(fits & ~only_newest & (F.col("_t") > cutoff))
    by_slice = Window.partitionBy("_key", "_slice").orderBy(F.col("_t").desc(), *tie)
    ranked = joined.filter(~fits | only_newest).withColumn("_rank", F.col("_newer") + F.row_number().over(by_slice))
    edge = ranked.filter((F.col("_rank") <= limit) & ((F.col("_t") > cutoff) | (F.col("_rank") == 1)))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def stage_summary(tasks: DataFrame) -> DataFrame:
    """Per stage: tasks, failures, run and GC time, bytes, and duration quantiles."""
    quantiles = F.percentile_approx("duration_ms", [0.5, 0.95])
    return (
        tasks.groupBy("app_log", "stage_id", "attempt")
        .agg(
            F.count("*").alias("tasks"),
            F.count_if("failed").alias("failed_tasks"),
            F.sum("run_ms").alias("run_ms"),
            F.sum("gc_ms").alias("gc_ms"),
            F.sum("input_bytes").alias("input_bytes"),
            F.sum("output_bytes").alias("output_bytes"),
            F.sum("shuffle_read_bytes").alias("shuffle_read_bytes"),
            F.sum("shuffle_write_bytes").alias("shuffle_write_bytes"),
            F.sum("spilled_bytes").alias("spilled_bytes"),
            F.max("duration_ms").alias("max_task_ms"),
            quantiles.alias("_q"),
        )
        .withColumns({"p50_task_ms": F.col("_q")[0], "p95_task_ms": F.col("_q")[1]})
        .drop("_q")
    )


def stage_sketches(tasks: DataFrame) -> DataFrame:
    """Per application log and stage: `tasks` and `durations`, a quantile sketch of some hundred values that merges.

    To be stored once per run; `merged_quantiles` answers over any of the stored runs.
    """
    return tasks.groupBy("app_log", "stage_id").agg(F.count("duration_ms").alias("tasks"), F.kll_sketch_agg_bigint("duration_ms").alias("durations"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str] = ("stage_id",), shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """`by`, `tasks` and `quantiles` (milliseconds, one per share) over the stored sketches; ranks err by about 1.3 %."""
    merged = sketches.groupBy(*by).agg(F.sum("tasks").alias("tasks"), F.kll_merge_agg_bigint("durations").alias("_merged"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return merged.select(*by, "tasks", F.kll_sketch_get_quantile_bigint("_merged", wanted).alias("quantiles"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Per application log: jobs, active, failed and succeeded ones, and total duration."""
    ended = F.col("ended_at").isNotNull()
    ok = F.col("result") == "JobSucceeded"
    return jobs.groupBy("app_log").agg(
        F.count("*").alias("jobs"),
        F.count_if(~ended).alias("active_jobs"),
        F.count_if(ended & ~ok).alias("failed_jobs"),
        F.count_if(ended & ok).alias("succeeded_jobs"),
        F.sum(F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"),
    )
