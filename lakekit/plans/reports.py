"""Reporting queries over snapshot tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import band, map_values

ALL = "All"

# Band steps and status colours of the readiness dashboard.
TABLE_COUNT_STEPS = [(None, "red"), (1, "yellow"), (10, "green")]
SENTINEL_COUNT_STEPS = [(None, "red"), (1, "yellow"), (6, "green")]
FRESHNESS_STEPS = [(None, "green"), (24, "yellow"), (72, "red")]
RUN_STATUS_COLOURS = {"success": "green", "failed": "red", "running": "blue"}
DRIFT_LABELS = {"false": "MISSING", "true": "OK"}


def latest_snapshot(df: DataFrame, ts: str = "collected_at") -> DataFrame:
    """Rows of the newest snapshot, ties kept.

    The maximum is a scalar subquery: it is computed once, reads one column, and its value is
    pushed into the scan (or prunes partitions when `ts` is a partition column).
    """
    return df.filter(F.col(ts) == df.select(F.max(ts)).scalar())


def param_filter(df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Keep rows matching every parameter; values compare as text.

    `All` alone or in a list disables that filter, an empty list matches nothing.
    """
    for name, value in params.items():
        wanted = [value] if isinstance(value, (str, int)) else list(value)
        texts = [str(v) for v in wanted]
        if ALL in texts:
            continue
        df = df.filter(_matches(df, name, texts))
    return df


def _matches(df: DataFrame, name: str, texts: list[str]) -> Column:
    if not texts:
        return F.lit(False)
    # typed literals keep the filter pushable; text that is not a number can match no number
    if df.schema[name].dataType.typeName() in ("integer", "long", "short", "byte"):
        numbers = [int(t) for t in texts if t.lstrip("-").isdigit() and str(int(t)) == t]
        return F.col(name).isin(numbers) if numbers else F.lit(False)
    return F.col(name).cast("string").isin(texts)


def time_filter(df: DataFrame, ts: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Both bounds inclusive; without a start the last seven days before `end`."""
    end = end or datetime.now(timezone.utc)
    start = start or end - timedelta(days=7)
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def last_runs(df: DataFrame, domain: str) -> DataFrame:
    """Last run per schema of one domain."""
    return (
        latest_snapshot(df)
        .filter(F.col("catalog") == domain)
        .select(
            "schema_name",
            "last_run_status",
            "last_run_at",
            "last_run_duration_sec",
            "last_run_table_count",
            "last_run_execution_id",
            "last_run_version",
        )
        .orderBy("schema_name")
    )


def inventory_matrix(df: DataFrame, domain: str, cycle=ALL, schemas=ALL) -> DataFrame:
    """Tables per schema and cycle in the newest snapshot; a missing cycle shows as `N/A`."""
    kept = param_filter(
        latest_snapshot(df).filter(F.col("catalog") == domain), {"cycle": cycle, "schema_name": schemas}
    )
    return (
        kept.groupBy("schema_name", "cycle")
        .agg(F.count("*").alias("table_count"))
        .select("schema_name", F.coalesce(F.col("cycle").cast("string"), F.lit("N/A")).alias("cycle"), "table_count")
        .orderBy("schema_name", "cycle")
    )


def sentinel_coverage(df: DataFrame, cycle=ALL) -> DataFrame:
    """Markers per cycle with first and last month, newest cycle first."""
    return (
        param_filter(latest_snapshot(df), {"cycle": cycle})
        .groupBy("cycle")
        .agg(
            F.count("*").alias("sentinel_count"),
            F.min("month").alias("earliest_month"),
            F.max("month").alias("latest_month"),
        )
        .orderBy(F.col("cycle").desc())
    )


def series_label(schema: str = "schema_name", cycle: str = "cycle") -> Column:
    """`schema` or `schema / cycle`."""
    tail = F.when(F.col(cycle).isNotNull(), F.concat(F.lit(" / "), F.col(cycle).cast("string")))
    return F.concat(F.col(schema), F.coalesce(tail, F.lit("")))


def row_count_series(
    df: DataFrame, domain: str, cycle=ALL, schemas=ALL, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Rows per time and label."""
    kept = time_filter(df, "collected_at", start, end).filter(F.col("catalog") == domain)
    return (
        param_filter(kept, {"cycle": cycle, "schema_name": schemas})
        .groupBy(F.col("collected_at").alias("time"), series_label().alias("metric"))
        .agg(F.sum("row_count").alias("value"))
        .orderBy("time")
    )


def drift_list(df: DataFrame, cycle=ALL) -> DataFrame:
    """Families that have data but no registration, newest cycle first."""
    return (
        param_filter(latest_snapshot(df).filter(~F.col("in_registry")), {"cycle": cycle})
        .select("form_family", "cycle", "in_registry")
        .orderBy(F.col("cycle").desc(), "form_family")
    )


def freshness_list(df: DataFrame) -> DataFrame:
    """Age of every table's last commit in the newest snapshot."""
    return latest_snapshot(df).select("table_name", "age_hours").orderBy("table_name")


def choices(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """Distinct non-NULL values in order."""
    order = F.col(col).desc() if desc else F.col(col).asc()
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(order)


def reduce_series(df: DataFrame, key: str | Sequence[str], ts: str, value: str) -> DataFrame:
    """Per series: last non-NULL value, maximum, and number of non-NULL samples.

    At equal newest timestamps the larger value is the last one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sample = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(
        F.max(sample)["v"].alias("last_value"),
        F.max(value).alias("max_value"),
        F.count(value).alias("samples"),
    )


def preview(df: DataFrame, max_rows: int = 1000, order_by: Sequence | None = None) -> tuple[DataFrame, bool]:
    """At most `max_rows` rows in order, and whether there were more.

    The order makes the result stable; Spark keeps only the first rows of every partition.
    """
    ordered = df.orderBy(*(order_by or df.columns))
    truncated = df.limit(max_rows + 1).count() > max_rows
    return ordered.limit(max_rows), truncated


def run_sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """SQL text with named parameters; values are never pasted into the text."""
    return spark.sql(text, args=dict(args or {}))


def readiness_report(snapshots: Mapping[str, DataFrame], params: Mapping[str, object]) -> dict[str, DataFrame]:
    """One DataFrame per dashboard panel from the six snapshot tables.

    `params`: `domain`, optional `cycle`, `schemas`, `start`, `end`.
    """
    domain = params["domain"]
    cycle, schemas = params.get("cycle", ALL), params.get("schemas", ALL)
    series = row_count_series(
        snapshots["row_counts"], domain, cycle, schemas, params.get("start"), params.get("end")
    )
    return {
        "last_runs": last_runs(snapshots["run_status"], domain).withColumn(
            "colour", map_values(F.col("last_run_status"), RUN_STATUS_COLOURS)
        ),
        "inventory": inventory_matrix(snapshots["table_inventory"], domain, cycle, schemas).withColumn(
            "colour", band(F.col("table_count"), TABLE_COUNT_STEPS)
        ),
        "sentinels": sentinel_coverage(snapshots["sentinels"], cycle).withColumn(
            "colour", band(F.col("sentinel_count"), SENTINEL_COUNT_STEPS)
        ),
        "row_counts": series,
        "row_count_legend": reduce_series(series, "metric", "time", "value"),
        "drift": drift_list(snapshots["schema_drift"], cycle).withColumn(
            "label", map_values(F.col("in_registry").cast("string"), DRIFT_LABELS)
        ),
        "freshness": freshness_list(snapshots["freshness"]).withColumn(
            "colour", band(F.col("age_hours"), FRESHNESS_STEPS)
        ),
        "cycles": choices(snapshots["table_inventory"], "cycle", desc=True),
        "schemas": choices(snapshots["table_inventory"], "schema_name"),
    }
