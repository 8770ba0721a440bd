"""Aggregates over a growing folder, brought up to date from new files alone.

A refresh works out partial aggregates of the files that were not seen before, one row per key, and
stores them. Sums, counts, extremes and sketches merge, so the table that readers see merges the
partials by key, and equals the aggregate over all files. `compact` merges the stored partials.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import LOCATION_KEY, ROOT_KEY, TABLE_KEY, new_version
from ..session import delete_path
from ..sources.catalog import VERSION_MARK, quoted, view_properties
from ..sources.files import stream_path

# per measure: its partials, and the measure from merged partials
PARTIALS = {
    "count": {"n": "count({c})"},
    "sum": {"s": "sum({c})"},
    "min": {"least": "min({c})"},
    "max": {"most": "max({c})"},
    "avg": {"s": "sum(cast({c} AS double))", "n": "count({c})"},
    "distinct": {"hll": "hll_sketch_agg({c})"},
    "quantiles": {"kll": "kll_sketch_agg_double(cast({c} AS double))"},
}
MERGED = {"n": "sum({p})", "s": "sum({p})", "least": "min({p})", "most": "max({p})", "hll": "hll_union_agg({p})", "kll": "kll_merge_agg_double({p})"}
FINAL = {
    "count": "{n}", "sum": "{s}", "min": "{least}", "max": "{most}", "avg": "{s} / {n}",
    "distinct": "hll_sketch_estimate({hll})",
    "quantiles": "kll_sketch_get_quantile_double({kll}, array(0.05D, 0.5D, 0.95D))",
}
BASE_KEY, MERGED_KEY = "lakekit.rollup", "lakekit.rollup_merged"


@dataclass(frozen=True)
class Rollup:
    """`measures` maps a name to (`count`, `sum`, `min`, `max`, `avg`, `distinct` or `quantiles`, expression).

    `distinct` is an estimate and `quantiles` are the estimated 5th, 50th and 95th percentile, from
    Spark's own sketches. `transform` works row by row.
    """

    name: str
    source: str
    source_schema: StructType
    keys: Sequence[str]
    measures: Mapping[str, tuple[str, str]]
    root: str
    transform: Callable[[DataFrame], DataFrame] = lambda df: df
    max_files_per_trigger: int | None = None

    def partials(self, rows: DataFrame) -> DataFrame:
        """One row per key with the partials of all measures."""
        found = [
            F.expr(text.format(c=c)).alias(f"{m}__{p}") for m, (kind, c) in self.measures.items() for p, text in PARTIALS[kind].items()
        ]
        return self.transform(rows).groupBy(*self.keys).agg(*found)

    def merged(self, partials: DataFrame) -> DataFrame:
        """Partials merged by key, to be merged again."""
        names = [f"{m}__{p}" for m, (kind, _) in self.measures.items() for p in PARTIALS[kind]]
        return partials.groupBy(*self.keys).agg(*[F.expr(MERGED[n.rsplit("__", 1)[1]].format(p=f"`{n}`")).alias(n) for n in names])

    def query(self, table: str) -> str:
        """SQL of what readers see."""
        keys = [f"`{k}`" for k in self.keys]
        shown = []
        for m, (kind, _) in self.measures.items():
            parts = {p: MERGED[p].format(p=f"`{m}__{p}`") for p in PARTIALS[kind]}
            shown.append(f"{FINAL[kind].format(**parts)} AS `{m}`")
        grouped = f" GROUP BY {', '.join(keys)}" if keys else ""
        return f"SELECT {', '.join(keys + shown)} FROM {quoted(table)}{grouped}"


def _publish(spark: SparkSession, spec: Rollup, base: str, location: str, merged: int) -> None:
    """A physical table over the partials at `location`, and the view over it, in one replacement."""
    rows = f"{spec.name}{VERSION_MARK}{location.rsplit('/', 1)[-1]}"
    if not spark.catalog.tableExists(rows):
        schema = spec.partials(spark.createDataFrame([], spec.source_schema)).schema
        place = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {quoted(rows)} ({schema.toDDL()}, `_batch` BIGINT) USING parquet PARTITIONED BY (`_batch`) LOCATION '{place}'")
    props = {TABLE_KEY: rows, ROOT_KEY: spec.root, LOCATION_KEY: location, BASE_KEY: base, MERGED_KEY: str(merged)}
    text = ", ".join(f"'{k}' = '{v}'" for k, v in props.items())
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(spec.name)} TBLPROPERTIES ({text}) AS {spec.query(rows)}")


def refresh_rollup(spark: SparkSession, spec: Rollup, full: bool = False) -> str:
    """Bring the table up to date with the files at its source; returns the folder of the generation in use.

    Only new files are read. A batch that is run again writes its own partials anew, so nothing counts
    twice. `full` makes a new generation from all files, which is published once it is complete.
    """
    props = view_properties(spark, spec.name) if spark.catalog.tableExists(spec.name) else {}
    base = props.get(BASE_KEY)
    fresh = full or base is None
    if fresh:
        base = f"{spec.root.rstrip('/')}/{spec.name.split('.')[-1]}/{new_version()}"
    location = f"{base}/{new_version()}" if fresh else props[LOCATION_KEY]
    merged = -1 if fresh else int(props[MERGED_KEY])
    if fresh:
        # no rows, so that the place is there even if the source has no files
        empty = spec.partials(spark.createDataFrame([], spec.source_schema)).schema
        spark.createDataFrame([], empty).write.parquet(f"{location}/_batch=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        # what compaction has merged is not to be written again
        if batch_id > merged:
            spec.partials(batch).write.mode("overwrite").parquet(f"{location}/_batch={batch_id}")

    source = stream_path(spark, spec.source, spec.source_schema, max_files_per_trigger=spec.max_files_per_trigger)
    query = source.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if fresh:
        _publish(spark, spec, base, location, merged)
    rows = view_properties(spark, spec.name)[TABLE_KEY]
    spark.sql(f"ALTER TABLE {quoted(rows)} RECOVER PARTITIONS")
    spark.catalog.refreshTable(rows)
    return base


def compact_rollup(spark: SparkSession, spec: Rollup) -> int:
    """Merge the stored partials into one row per key; returns how many batches were merged.

    The merged rows are a new table, to which readers switch at once; the old one goes with its files.
    Not to be run beside a refresh.
    """
    props = view_properties(spark, spec.name)
    old = spark.table(props[TABLE_KEY])
    batches = sorted(r[0] for r in old.select("_batch").distinct().collect())
    if len(batches) < 2:
        return 0
    location = f"{props[BASE_KEY]}/{new_version()}"
    spec.merged(old).write.parquet(f"{location}/_batch={batches[-1]}")
    _publish(spark, spec, props[BASE_KEY], location, batches[-1])
    rows = view_properties(spark, spec.name)[TABLE_KEY]
    spark.sql(f"ALTER TABLE {quoted(rows)} RECOVER PARTITIONS")
    spark.catalog.refreshTable(rows)
    spark.sql(f"DROP TABLE {quoted(props[TABLE_KEY])}")
    delete_path(spark, props[LOCATION_KEY])
    return len(batches)
