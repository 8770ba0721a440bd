"""Table descriptors as rows: describing, comparing and checking them set-wise.

A descriptor is one row per column: `(table_name, column_name, type_text, type_json, type_name,
position, nullable, partition_index, format, location)`. Comparisons turn both sides into facts
keyed by `(table, check, ordinal)` and group them, so no list of columns is ever collected and
any number of tables is compared in two aggregations.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.types import type_kind

DESCRIPTOR = (
    "table_name string, column_name string, type_text string, type_json string, position int, "
    "nullable boolean, partition_index int, format string, location string"
)


def describe_schema(
    spark: SparkSession,
    schemas: Mapping[str, StructType],
    partition_by: Mapping[str, Sequence[str]] | None = None,
    formats: Mapping[str, str] | None = None,
    locations: Mapping[str, str] | None = None,
) -> DataFrame:
    """Descriptor rows of the given schemas. Only metadata passes through the driver."""
    out = []
    for table, schema in schemas.items():
        parts = list((partition_by or {}).get(table, ()))
        unknown = set(parts) - set(schema.names)
        if unknown:
            raise ValueError(f"{table}: no such partition column: {sorted(unknown)}")
        for i, field in enumerate(schema.fields):
            out.append(
                (
                    table,
                    field.name,
                    field.dataType.simpleString().upper(),
                    json.dumps(field.jsonValue()),
                    i,
                    field.nullable,
                    parts.index(field.name) if field.name in parts else None,
                    (formats or {}).get(table, "parquet"),
                    (locations or {}).get(table),
                )
            )
    rows = spark.createDataFrame(out, DESCRIPTOR)
    return rows.withColumn("type_name", type_kind(F.col("type_text")))


# Fixed value: the fields of a registry's column entry.
COLUMN_JSON = (
    "array<struct<name: string, type_text: string, type_json: string, type_name: string, position: int, "
    "nullable: boolean, partition_index: int>>"
)


def descriptors_from_json(df: DataFrame, table: str, columns: str) -> DataFrame:
    """Descriptor rows from a registry's answers: one row per table, its columns as a JSON array.

    The text is parsed against the declared fields, so nested keys of the same name do not matter.
    """
    entry = F.explode(F.from_json(F.col(columns), COLUMN_JSON)).alias("c")
    return df.select(F.col(table).alias("table_name"), entry).select(
        "table_name", F.col("c.name").alias("column_name"), *[
            f"c.{f}" for f in ("type_text", "type_json", "type_name", "position", "nullable", "partition_index")
        ]
    )


def partition_columns(desc: DataFrame) -> DataFrame:
    """`(table_name, cols)`: partition columns in the order of their index.

    Rows with no index or a negative one are not partition columns; a table without any has an
    empty list. A set keeps each `(index, name)` once, so a list is as long as the partition spec.
    """
    is_part = F.col("partition_index").isNotNull() & (F.col("partition_index") >= 0)
    entry = F.when(is_part, F.struct(F.col("partition_index").alias("i"), F.col("column_name").alias("n")))
    return desc.groupBy("table_name").agg(
        F.transform(F.sort_array(F.collect_set(entry)), lambda e: e["n"]).alias("cols")
    )


def _facts(desc: DataFrame, side: str, table_level: str) -> DataFrame:
    """Facts `(table_name, check, ordinal, name, type, nullable, side)` of one descriptor table."""

    def fact(check: str, ordinal: Column, name: Column, typ: Column, nullable: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            ordinal.cast("int").alias("ordinal"),
            name.cast("string").alias("name"),
            typ.cast("string").alias("type"),
            nullable.cast("boolean").alias("nullable"),
        )

    none = F.lit(None)
    level = F.lower(F.col(table_level)) if table_level == "format" else F.col(table_level)
    facts = F.array(
        # every column repeats the table-level value; they combine to one fact before the shuffle
        fact("1table", F.lit(0), level, none, none),
        fact("2columns", F.col("position"), F.col("column_name"), F.lower("type_text"), F.col("nullable")),
        F.when(
            F.col("partition_index") >= 0,
            fact("3partitions", F.col("partition_index"), F.col("column_name"), none, none),
        ),
    )
    return (
        desc.select("table_name", F.explode(facts).alias("f"))
        .filter(F.col("f").isNotNull())
        .select("table_name", "f.*", F.lit(side).alias("side"))
    )


def _paired(left: DataFrame, right: DataFrame, table_level: str) -> DataFrame:
    """Both sides of every fact next to each other: `(table_name, check, ordinal, l, r, reason)`."""
    facts = _facts(left, "l", table_level).unionByName(_facts(right, "r", table_level))
    value = F.struct("name", "type", "nullable")
    paired = facts.groupBy("table_name", "check", "ordinal").agg(
        F.max(F.when(F.col("side") == "l", value)).alias("l"),
        F.max(F.when(F.col("side") == "r", value)).alias("r"),
    )

    def differs(field: str) -> Column:
        return ~F.col(f"l.{field}").eqNullSafe(F.col(f"r.{field}"))

    what = (
        F.when(F.col("l").isNull(), F.lit("added"))
        .when(F.col("r").isNull(), F.lit("removed"))
        .when(differs("name"), F.lit("name"))
        .when(differs("type"), F.lit("type"))
        .when(differs("nullable"), F.lit("nullable"))
    )
    return paired.withColumn("reason", what)


def plan_change(existing: DataFrame, requested: DataFrame, rule: str = "full") -> DataFrame:
    """`(table_name, action, reason)` for every table of either side.

    Checks run in the order format, columns, partition list; the first difference is the reason.
    `rule='full'` compares column name, type, nullability and order; `rule='arity'` only the number
    of columns. Actions: `create` (not there yet), `reuse`, `recreate`, `ignore` (not requested).
    """
    if rule not in ("full", "arity"):
        raise ValueError(f"unknown rule {rule!r}")
    paired = _paired(existing, requested, "format")
    label = (
        F.when(F.col("check") == "1table", F.lit("format"))
        .when(F.col("check") == "3partitions", F.lit("partitions"))
        .otherwise(F.concat(F.lit("column "), F.col("ordinal"), F.lit(" "), F.col("reason")))
    )
    counted = F.col("check") == "2columns"
    considered = F.col("reason").isNotNull() & (F.lit(rule == "full") | ~counted)
    per_table = paired.groupBy("table_name").agg(
        F.count(F.when(counted, F.col("l"))).alias("n_l"),
        F.count(F.when(counted, F.col("r"))).alias("n_r"),
        F.min(F.when(considered, F.struct("check", "ordinal", label.alias("label")))).alias("first"),
    )
    arity = F.lit(rule == "arity") & (F.col("n_l") != F.col("n_r"))
    first_is_format = F.coalesce(F.col("first.check") == "1table", F.lit(False))
    reason = (
        F.when(F.col("n_l") == 0, F.lit("missing"))
        .when(F.col("n_r") == 0, F.lit("not requested"))
        .when(arity & ~first_is_format, F.lit("column count"))
        .otherwise(F.col("first.label"))
    )
    action = (
        F.when(F.col("n_l") == 0, F.lit("create"))
        .when(F.col("n_r") == 0, F.lit("ignore"))
        .when(F.col("reason").isNull(), F.lit("reuse"))
        .otherwise(F.lit("recreate"))
    )
    return per_table.withColumn("reason", reason).select("table_name", action.alias("action"), "reason")


def registry_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Drift between two registries, one row per table of either side.

    `(table_name, location_changed, schema_changed, partition_changed, missing_in)`. A table one
    side lacks is missing there and never "changed".
    """
    paired = _paired(left, right, "location")
    columns = F.col("check") == "2columns"

    def changed(check: str) -> Column:
        return F.bool_or((F.col("check") == check) & F.col("reason").isNotNull())

    per_table = paired.groupBy("table_name").agg(
        F.count(F.when(columns, F.col("l"))).alias("n_l"),
        F.count(F.when(columns, F.col("r"))).alias("n_r"),
        changed("1table").alias("location"),
        changed("2columns").alias("schema"),
        changed("3partitions").alias("partition"),
    )
    both = (F.col("n_l") > 0) & (F.col("n_r") > 0)
    return per_table.select(
        "table_name",
        *[(both & F.col(c)).alias(f"{c}_changed") for c in ("location", "schema", "partition")],
        F.when(F.col("n_l") == 0, F.lit("left")).when(F.col("n_r") == 0, F.lit("right")).alias("missing_in"),
    )


def valid_names(df: DataFrame, col: str) -> DataFrame:
    """`(name, ok, reason)`: letters, digits, `_` and `-` only, at least one of them."""
    name = F.col(col)
    reason = (
        F.when(name.isNull(), F.lit("null"))
        .when(name == "", F.lit("empty"))
        .when(~name.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit("bad character"))
    )
    return df.select(name.alias("name"), reason.isNull().alias("ok"), reason.alias("reason"))


def clean_location(col: Column) -> Column:
    """One spelling per directory: no trailing slash, `file:/x` for `file:///x`."""
    return F.regexp_replace(F.regexp_replace(col, r"/+$", ""), r"^file:/+", "file:/")


def orphans(files: DataFrame, catalog: DataFrame, directory: str = r"^(.*?)(?:/[^/=]+=[^/]*)*/[^/]+$") -> DataFrame:
    """Directories with data but no entry, and entries with no data.

    `files` has `(path, length)`, `catalog` `(table_name, location)`; group 1 of `directory` is the
    table's directory, by default without partition folders. Files are counted per directory before the join, so a directory with a
    third of all files is one row by then.
    """
    per_dir = (
        files.select(clean_location(F.regexp_extract("path", directory, 1)).alias("location"), "length")
        .filter(F.col("location") != "")
        .groupBy("location")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )
    entries = catalog.select("table_name", clean_location(F.col("location")).alias("location"))
    loose = per_dir.join(entries, "location", "left_anti").select(
        F.lit("no entry").alias("kind"), "location", F.lit(None).cast("string").alias("table_name"), "files", "bytes"
    )
    empty = entries.join(per_dir, "location", "left_anti").select(
        F.lit("no data").alias("kind"),
        "location",
        "table_name",
        F.lit(0).cast("bigint").alias("files"),
        F.lit(0).cast("bigint").alias("bytes"),
    )
    return loose.unionByName(empty)
