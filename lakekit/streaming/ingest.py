"""File stream to table, refresh of derived tables, and the streaming marker feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import GENERATION_KEY, new_version, publish
from ..plans.readiness import sentinels
from ..sources.catalog import VERSION_MARK, quoted, view_properties
from ..sources.files import stream_path


def start_append(sdf: DataFrame, path: str, checkpoint: str, trigger: str = "availableNow", fmt: str = "parquet", partition_by=()):
    """Start to append a stream to files at `path`; returns the running query."""
    writer = sdf.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    timed = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return timed.start(path)


def stream_to_table(
    sdf: DataFrame, path: str, checkpoint: str, trigger: str = "availableNow", fmt: str = "parquet", partition_by=()
):
    """Append a stream to files at `path`, each input row exactly once across restarts.

    `availableNow` processes what is there and returns when done; any other trigger is a
    processing-time interval and returns the running query. A missing checkpoint starts clean.
    """
    query = start_append(sdf, path, checkpoint, trigger, fmt, partition_by)
    if trigger == "availableNow":
        query.awaitTermination()
    return query


@dataclass(frozen=True)
class Derived:
    """A table derived from a growing folder: `transform` must be usable on a stream."""

    name: str
    source: str
    source_schema: StructType
    transform: Callable[[DataFrame], DataFrame]
    root: str
    max_files_per_trigger: int | None = None


def refresh(spark: SparkSession, spec: Derived, full: bool = False) -> str:
    """Bring a derived table up to date; returns the folder of the generation that is published.

    Incremental: rows of files not seen before are appended. Full: everything is rebuilt in a new
    generation with its own checkpoint, which is published once it is complete, so readers never
    see a half-filled table.
    """
    props = view_properties(spark, spec.name)
    base = props.get(GENERATION_KEY)
    fresh = full or base is None
    if fresh:
        base = f"{spec.root.rstrip('/')}/{spec.name.split('.')[-1]}/{new_version()}"
    source = stream_path(spark, spec.source, spec.source_schema, max_files_per_trigger=spec.max_files_per_trigger)
    out = spec.transform(source)
    stream_to_table(out, f"{base}/rows", f"{base}/checkpoint")
    rows = f"{spec.name}{VERSION_MARK}{base.rsplit('/', 1)[-1]}"
    if fresh:
        # a declared schema, so that a source without files gives an empty table
        place = f"{base}/rows".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {quoted(rows)} ({out.schema.toDDL()}) USING parquet LOCATION '{place}'")
        publish(spark, spec.name, rows, f"{base}/rows", out.columns, "parquet", [], spec.root, {GENERATION_KEY: base})
    spark.catalog.refreshTable(rows)
    return base


def stream_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files below `root` as a stream of `(path, length, modified_at)`; content is not read.

    Spark's file sources pass over files of zero length. Empty markers are fed by `list_markers`
    and `append_absent` instead, which adds each marker once however often it runs.
    """
    # Fixed value: the schema of the binaryFile source.
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified_at"))


def stream_sentinels(files: DataFrame, stamp: str | None = None) -> DataFrame:
    """Completion markers of a file stream as snapshot rows.

    `collected_at` is the processing time, or column `stamp` of the stream when given.
    """
    return sentinels(files, F.current_timestamp() if stamp is None else F.col(stamp))
