"""Six readiness collectors and the run that appends their snapshots.

Every collector takes DataFrames (a listing, an inventory, a properties table) and returns the
snapshot rows stamped with one `collected_at`. None of them reads storage by itself, so they run
the same on a listing of a test folder and on a table of a billion file names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    file_name,
    hours_between,
    int_or_null,
    iso_timestamp,
    map_get,
    name_cycle,
    name_family,
    none_if_empty,
    path_key,
    strip_suffix,
)
from ..operators.merge import append_absent

# The property names a run leaves on its schema.
RUN_PROPERTY = "pipeline.last_run_"

# Keys that make a snapshot row unique.
SNAPSHOT_KEYS = {
    "run_status": ["collected_at", "catalog", "schema_name"],
    "table_inventory": ["collected_at", "catalog", "schema_name", "table_name"],
    "row_counts": ["collected_at", "catalog", "schema_name", "table_name"],
    "sentinels": ["collected_at", "sentinel_key"],
    "schema_drift": ["collected_at", "form_family", "cycle"],
    "freshness": ["collected_at", "table_name"],
}


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _stamp(now: datetime | Column) -> Column:
    return _column(now).cast("timestamp").alias("collected_at")


def pipeline_status(props: DataFrame, now, catalog: str | Column) -> DataFrame:
    """Typed run status per schema from `(name, properties)`.

    Unreadable times and numbers become NULL and set `parse_error`.
    """

    names = ["status", "at", "duration_sec", "table_count", "execution_id", "version"]
    # read, then parse, then judge: each property is looked up and parsed once
    read = props.select(
        _stamp(now),
        _column(catalog).alias("catalog"),
        F.col("name").alias("schema_name"),
        *[map_get(F.col("properties"), RUN_PROPERTY + n).alias(n) for n in names],
    )
    parsed = read.withColumns(
        {
            "last_run_at": iso_timestamp(F.col("at")),
            "last_run_duration_sec": int_or_null(F.col("duration_sec")),
            "last_run_table_count": int_or_null(F.col("table_count")),
        }
    )

    def broken(name: str) -> Column:
        return (F.coalesce(F.trim(name), F.lit("")) != "") & F.col(f"last_run_{name}").isNull()

    return parsed.select(
        "collected_at",
        "catalog",
        "schema_name",
        F.col("status").alias("last_run_status"),
        "last_run_at",
        "last_run_duration_sec",
        "last_run_table_count",
        F.col("execution_id").alias("last_run_execution_id"),
        F.col("version").alias("last_run_version"),
        (broken("at") | broken("duration_sec") | broken("table_count")).alias("parse_error"),
    )


def table_inventory(tables: DataFrame, now, catalog: str | Column) -> DataFrame:
    """`(schema_name, table_name)` with cycle and family taken from the name's suffix."""
    return tables.select(
        _stamp(now),
        _column(catalog).alias("catalog"),
        "schema_name",
        "table_name",
        name_cycle(F.col("table_name")).alias("cycle"),
        name_family(F.col("table_name")).alias("form_family"),
    )


def row_count_snapshot(inventory: DataFrame, counts: DataFrame, now) -> DataFrame:
    """Row counts of the inventoried tables; tables without files or count are left out."""
    known = counts.filter(F.col("row_count").isNotNull()).select("schema_name", "table_name", "row_count")
    return inventory.join(known, ["schema_name", "table_name"]).select(
        _stamp(now), "catalog", "schema_name", "table_name", "cycle", F.col("row_count").cast("bigint").alias("row_count")
    )


def sentinels(files: DataFrame, now=None) -> DataFrame:
    """One row per `cycle=<yyyy>/_months/<month>.done` file; other files are ignored.

    Without `now` no stamp is added, which is the form a stream uses.
    """
    out = [
        path_key(F.col("path"), "cycle", "int").alias("cycle"),
        strip_suffix(file_name(F.col("path")), ".done").alias("month"),
        F.col("path").alias("sentinel_key"),
    ]
    marked = files.filter(F.col("path").endswith(F.lit(".done")) & F.col("path").rlike(r"(^|/)cycle=\d{4}/_months/[^/]+$"))
    return marked.select(*([] if now is None else [_stamp(now)]), *out)


def schema_drift(files: DataFrame, registry: DataFrame | None, now) -> DataFrame:
    """Distinct `(form_family, cycle)` on storage and whether the family is registered.

    The distinct runs before the lookup, so the join sees one row per family and cycle. An absent
    registry counts as empty. Families that are only registered are not reported.
    """
    on_storage = (
        files.select(
            path_key(F.col("path"), "form_family").alias("form_family"),
            none_if_empty(F.regexp_extract("path", r"cycle=(\d{4})(?:/|$)", 1)).try_cast("int").alias("cycle"),
        )
        .filter(F.col("form_family").isNotNull() & F.col("cycle").isNotNull())
        .distinct()
    )
    if registry is None:
        flagged = on_storage.withColumn("in_registry", F.lit(False))
    else:
        known = registry.select(F.col("form_family").alias("_known")).distinct()
        flagged = on_storage.join(known, F.col("form_family") == F.col("_known"), "left").withColumn(
            "in_registry", F.col("_known").isNotNull()
        )
    return flagged.select(
        _stamp(now), "form_family", "cycle", F.lit(True).alias("has_data"), "in_registry"
    )


def freshness(files: DataFrame, now, table_pattern: str = r"^(.*/)_delta_log/[^/]+$") -> DataFrame:
    """Newest commit file per table and its age in hours; tables without commits are absent.

    `files` has `(path, modified_at)`; group 1 of the pattern is the table's directory, whose last
    segment is the table's name.
    """
    commits = files.select(
        none_if_empty(F.regexp_extract("path", table_pattern, 1)).alias("path"),
        F.col("modified_at").cast("timestamp").alias("modified_at"),
    ).filter(F.col("path").isNotNull())
    newest = commits.groupBy("path").agg(F.max("modified_at").alias("last_modified_at"))
    return newest.withColumn("collected_at", _stamp(now)).select(
        "collected_at",
        F.element_at(F.split("path", "/"), -2).alias("table_name"),
        "path",
        "last_modified_at",
        hours_between(F.col("collected_at"), F.col("last_modified_at")).alias("age_hours"),
    )


def run_readiness(
    spark: SparkSession, collectors: Mapping[str, Callable[[], DataFrame]], targets: Mapping[str, str], at_once: int = 4
) -> DataFrame:
    """Run every collector and append its snapshot; `(collector, rows, status, error)`.

    `collectors` maps a snapshot name to a function giving its rows, `targets` to the table. A
    failing collector is reported and the others still run. A repeated run adds nothing. Collectors of
    different tables run side by side, up to `at_once`; those of one table one after the other.
    """

    def one(name: str) -> tuple:
        try:
            return name, append_absent(collectors[name](), targets[name], SNAPSHOT_KEYS[name]), "ok", None
        except Exception as error:  # reported per collector, by design
            return name, None, "failed", str(error) or repr(error)

    lanes: dict[str | None, list[str]] = {}
    for name in collectors:
        lanes.setdefault(targets.get(name), []).append(name)
    with ThreadPoolExecutor(max(min(at_once, len(lanes)), 1)) as pool:
        lane = inheritable_thread_target(spark)(lambda names: [one(n) for n in names])
        runs = [pool.submit(lane, names) for names in lanes.values()]
        found = {row[0]: row for run in runs for row in run.result()}
    report = [found[name] for name in collectors]
    return spark.createDataFrame(report, "collector string, rows bigint, status string, error string")
