"""Table life cycle on file formats: create, write, replace, truncate, overwrite, compact, convert.

A published name is a view over one physical table, and every new state is written to a fresh
directory `root/<table>/<version>`, counted, and published by a single view replacement. Readers
see the old or the new rows; a failed write leaves neither an entry nor files. Superseded versions
stay until `expire_versions`, so running readers keep their files. What was computed from a table is
published only while that table is as it was; otherwise `Conflict` is raised and nothing changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete_path, materialise, scratch_path
from ..sources.catalog import (
    FILE_FORMATS,
    NAME,
    TABLE_KEY,
    VERSION,
    VERSION_MARK,
    physical_name,
    quoted,
    view_properties,
)
from ..sources.files import list_files
from .descriptors import describe_schema, plan_change

# Text formats keep microseconds only when told to.
TEXT_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
ROOT_KEY, FORMAT_KEY, PARTITION_KEY, LOCATION_KEY = (
    "lakekit.root",
    "lakekit.format",
    "lakekit.partition_by",
    "lakekit.location",
)


# Fixed value: the property of a table that is refreshed from a stream; a rewrite ends that.
GENERATION_KEY = "lakekit.generation"
# partitions that may be named in a filter
LISTED = 1000
OWN_KEYS = (TABLE_KEY, ROOT_KEY, FORMAT_KEY, PARTITION_KEY, LOCATION_KEY, GENERATION_KEY)


class Conflict(RuntimeError):
    """The table has changed since the rows to publish were read from it."""


@dataclass(frozen=True)
class Base:
    """The state of a table that new rows are computed from: its version and its files."""

    physical: str
    files: int
    bytes: int
    digest: int


def resolve_format(requested: str | None, session_default: str = "parquet", honour_explicit: bool = True) -> str:
    """Effective format: the request when it counts, else the session's default."""
    chosen = requested if requested and honour_explicit else session_default
    return chosen.lower()


def _full_name(spark: SparkSession, name: str) -> tuple[str, str]:
    parts = name.split(".")
    if len(parts) == 1:
        parts = [spark.catalog.currentDatabase(), *parts]
    if len(parts) != 2 or not all(NAME.match(p) for p in parts):
        raise ValueError(f"bad table name {name!r}")
    return parts[0], parts[1]


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    props = view_properties(spark, name)
    if not props.get(TABLE_KEY):
        raise ValueError(f"{name} is not a table of this life cycle")
    return props


def _partitions(props: dict[str, str]) -> list[str]:
    return [p for p in props.get(PARTITION_KEY, "").split(",") if p]


def partition_list(spark: SparkSession, name: str) -> list[str]:
    """Partition columns of `name`, in order."""
    return _partitions(_properties(spark, name))


def current(spark: SparkSession, name: str) -> DataFrame:
    """Rows of the physical table behind `name`, in its column order."""
    return spark.table(physical_name(spark, name))


def _format_options(fmt: str) -> dict[str, str]:
    return TEXT_OPTIONS if fmt in ("json", "csv") else {}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_of(spark: SparkSession, name: str) -> Base:
    """What `name` consists of now; to be taken before its rows are read."""
    props = _properties(spark, name)
    try:
        files = list_files(spark, props[LOCATION_KEY])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return Base(props[TABLE_KEY], 0, 0, 0)
    digest = F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modified_at")))
    found = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), digest.alias("digest")).first()
    return Base(props[TABLE_KEY], found["n"], found["bytes"] or 0, found["digest"] or 0)


def aligned(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """`df` with exactly `columns`; a column that the table lacks is an error, but for those named in `extra`."""
    unknown = [c for c in df.columns if c not in columns and c not in extra]
    if unknown:
        raise ValueError(f"the table has no columns {unknown}")
    return df.select(*columns)


def new_version() -> str:
    """Names of versions are in the order of their making."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f") + uuid.uuid4().hex[:8]


def _register(
    spark: SparkSession, name: str, schema: StructType, fmt: str, partition_by: Sequence[str], root: str
) -> tuple[str, str]:
    """Create the physical table of a new version; returns its name and location."""
    db, table = _full_name(spark, name)
    version = new_version()
    physical, location = f"{db}.{table}{VERSION_MARK}{version}", f"{root.rstrip('/')}/{table}/{version}"
    unknown = [c for c in partition_by if c not in schema.names]
    if unknown:
        raise ValueError(f"only identity partition columns are possible, not {unknown}")
    options = ", ".join(f"{_literal(k)} = {_literal(v)}" for k, v in _format_options(fmt).items())
    spark.sql(
        f"CREATE TABLE {quoted(physical)} ({schema.toDDL()}) USING {fmt}"
        + (f" OPTIONS ({options})" if options else "")
        + (f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else "")
        + f" LOCATION {_literal(location)}"
    )
    return physical, location


def publish(
    spark: SparkSession,
    name: str,
    physical: str,
    location: str,
    columns: Sequence[str],
    fmt: str,
    partition_by: Sequence[str],
    root: str,
    extra: dict[str, str] | None = None,
    base: Base | None = None,
    keep_properties: bool = True,
) -> None:
    """Make `physical` what readers of `name` see, in one statement.

    Properties that were published with earlier versions are carried over. With `base`, which the
    rows were computed from, a table that has changed since is left alone and `Conflict` is raised.
    """
    carried = view_properties(spark, name) if keep_properties else {}
    props = {
        **{k: v for k, v in carried.items() if k not in OWN_KEYS and not k.startswith(("view.", "transient"))},
        TABLE_KEY: physical,
        ROOT_KEY: root,
        FORMAT_KEY: fmt,
        PARTITION_KEY: ",".join(partition_by),
        LOCATION_KEY: location,
        **(extra or {}),
    }
    if base is not None and base_of(spark, name) != base:
        raise Conflict(f"{name} has changed meanwhile")
    text = ", ".join(f"{_literal(k)} = {_literal(v)}" for k, v in props.items())
    db, table = _full_name(spark, name)
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(f'{db}.{table}')} TBLPROPERTIES ({text}) AS "
        f"SELECT {', '.join(f'`{c}`' for c in columns)} FROM {quoted(physical)}"
    )


def _discard(spark: SparkSession, physical: str, location: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(physical)}")
    delete_path(spark, location)


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    root: str,
    partition_by: Sequence[str] = (),
    fmt: str | None = None,
    if_exists: str = "error",
) -> str:
    """Empty table with full schema and partition list; returns `created`, `reused` or `recreated`.

    Over an existing table: `error` raises, `reuse` keeps it when format, columns and partitions
    agree and raises otherwise, `recreate` starts empty. Only `recreate` gives up rows.
    """
    if if_exists not in ("error", "reuse", "recreate"):
        raise ValueError(f"unknown if_exists {if_exists!r}")
    _full_name(spark, name)
    fmt = resolve_format(fmt, spark.conf.get("spark.sql.sources.default"))
    exists = spark.catalog.tableExists(name)
    if exists and if_exists == "error":
        raise ValueError(f"{name} exists")
    if exists and if_exists == "reuse":
        props = _properties(spark, name)
        change = plan_change(
            describe_schema(spark, {name: spark.table(name).schema}, {name: _partitions(props)}, {name: props[FORMAT_KEY]}),
            describe_schema(spark, {name: _nullable(schema)}, {name: partition_by}, {name: fmt}),
        ).first()
        if change["action"] != "reuse":
            raise ValueError(f"{name} differs: {change['reason']}")
        return "reused"
    physical, location = _register(spark, name, _nullable(schema), fmt, partition_by, root)
    publish(spark, name, physical, location, schema.names, fmt, partition_by, root, keep_properties=False)
    return "recreated" if exists else "created"


def _nullable(schema: StructType) -> StructType:
    # file formats do not enforce NOT NULL
    out = StructType()
    for field in schema.fields:
        out = out.add(field.name, field.dataType, True)
    return out


def bootstrap_empty(
    spark: SparkSession, name: str, schema: StructType, root: str, partition_by: Sequence[str] = ()
) -> None:
    """Table that is readable, with 0 rows and the right schema, before its first write."""
    create_table(spark, name, schema, root, partition_by)


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "create",
    root: str | None = None,
    fmt: str | None = None,
    partition_by: Sequence[str] | None = None,
    properties: dict[str, str] | None = None,
    base: Base | None = None,
    honour_explicit: bool = True,
    shown: Sequence[str] | None = None,
) -> None:
    """Write `df` as a new version of `name` and publish it after its row count was verified.

    `mode`: `create` (must be absent), `replace` (must exist) or `create_or_replace`. Root, format
    and partition list of an existing table are kept unless given.

    `properties` are published together with the rows, in the same statement. `base` is the state
    that `df` was computed from, if it was computed from this table. `honour_explicit=False` lets
    the session's default format win over `fmt`. Readers see the columns `shown`, by default all.

    A partitioned write is rebalanced by the partition columns, which bounds the number of files
    and lets adaptive execution split a partition value that holds much of the rows.
    """
    spark = df.sparkSession
    if mode not in ("create", "replace", "create_or_replace"):
        raise ValueError(f"unknown mode {mode!r}")
    _full_name(spark, name)
    exists = spark.catalog.tableExists(name)
    if exists and mode == "create":
        raise ValueError(f"{name} exists")
    if not exists and mode == "replace":
        raise ValueError(f"{name} does not exist")
    props = _properties(spark, name) if exists else {}
    root = root or props.get(ROOT_KEY)
    if root is None:
        raise ValueError("a new table needs a root")
    fmt = resolve_format(fmt or props.get(FORMAT_KEY), spark.conf.get("spark.sql.sources.default"), honour_explicit)
    parts = list(_partitions(props) if partition_by is None else partition_by)
    _write_version(df, name, root, fmt, parts, True, properties, base, shown)


def _write_version(
    df: DataFrame,
    name: str,
    root: str,
    fmt: str,
    parts: list[str],
    rebalance: bool,
    extra: dict[str, str] | None = None,
    base: Base | None = None,
    shown: Sequence[str] | None = None,
) -> None:
    spark = df.sparkSession
    physical, location = _register(spark, name, _nullable(df.schema), fmt, parts, root)
    try:
        written = _save(df, fmt, location, parts, rebalance)
        if parts:
            spark.sql(f"ALTER TABLE {quoted(physical)} RECOVER PARTITIONS")
        found = spark.table(physical).count()
        if found != written:
            raise RuntimeError(f"{name}: wrote {written} rows, read {found}")
        publish(spark, name, physical, location, shown or df.columns, fmt, parts, root, extra, base)
    except BaseException:
        _discard(spark, physical, location)
        raise


def _save(df: DataFrame, fmt: str, location: str, parts: list[str], rebalance: bool, mode: str = "append") -> int:
    spread = df.hint("rebalance", *parts) if parts and rebalance else df
    seen = Observation()
    # observed in the writing stage itself, so a re-run of an earlier stage cannot count twice
    counted = spread.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = counted.write.format(fmt).options(**_format_options(fmt)).mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).save(location)
    return seen.get["n"]


def truncate(spark: SparkSession, name: str) -> None:
    """Remove all rows, keep schema, format and partition list."""
    props = _properties(spark, name)
    schema = spark.table(name).schema
    parts = _partitions(props)
    physical, location = _register(spark, name, schema, props[FORMAT_KEY], parts, props[ROOT_KEY])
    publish(spark, name, physical, location, schema.names, props[FORMAT_KEY], parts, props[ROOT_KEY])


def append(df: DataFrame, name: str) -> None:
    """Append rows to the current version, matching columns by name; unknown columns are an error."""
    spark = df.sparkSession
    aligned(df, current(spark, name).columns).write.insertInto(physical_name(spark, name))
    spark.catalog.refreshTable(name)


def overwrite(df: DataFrame, name: str, how: str = "all", where: Column | None = None) -> None:
    """Overwrite `all` rows, the partitions present in the input (`dynamic`), or rows by `where`.

    `dynamic` rewrites only the touched partitions in place; readers may see it partition by
    partition. `where` replaces the rows for which the condition is true; rows for which it is
    false or NULL are kept. It is written as a new version.
    """
    spark = df.sparkSession
    props = _properties(spark, name)
    if how == "all":
        write_table(df, name, "replace")
    elif how == "dynamic":
        parts = _partitions(props)
        if not parts:
            raise ValueError(f"{name} is not partitioned")
        _save(aligned(df, current(spark, name).columns), props[FORMAT_KEY], props[LOCATION_KEY], parts, True, mode="overwrite")
        spark.sql(f"ALTER TABLE {quoted(props[TABLE_KEY])} RECOVER PARTITIONS")
        spark.catalog.refreshTable(props[TABLE_KEY])
        spark.catalog.refreshTable(name)
    elif how == "where":
        if where is None:
            raise ValueError("how='where' needs a condition")
        base = base_of(spark, name)
        kept = spark.table(name).filter(~where | where.isNull())
        write_table(kept.unionByName(df), name, "replace", base=base)
    else:
        raise ValueError(f"unknown how {how!r}")


def versions(spark: SparkSession, name: str) -> list[str]:
    """Physical tables of `name`, oldest first."""
    db, table = _full_name(spark, name)
    shown = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{db}` LIKE '{table}{VERSION_MARK}*'").collect()]
    return sorted(f"{db}.{t}" for t in shown if VERSION.sub("", t).lower() == table.lower() and VERSION.search(t))


def expire_versions(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Drop superseded versions with their files, keeping the newest `keep` and the published one.

    A name that does not say which version is published is refused.
    """
    live = _properties(spark, name)[TABLE_KEY].lower()
    old = [v for v in versions(spark, name)[: -max(keep, 1)] if v.lower() != live]
    for physical in old:
        location = _location(spark, physical).rstrip("/")
        version = physical.rsplit(VERSION_MARK, 1)[-1]
        # a refreshed generation has its checkpoint beside its rows
        _discard(spark, physical, location.removesuffix("/rows") if location.endswith(f"/{version}/rows") else location)
    return old


def _location(spark: SparkSession, physical: str) -> str:
    described = spark.sql(f"DESCRIBE EXTENDED {quoted(physical)}").collect()
    return next(r["data_type"] for r in described if r["col_name"] == "Location")


def drop(spark: SparkSession, name: str, purge: bool = False) -> None:
    """Drop a table; a missing one is no error. `purge` deletes the files of all versions too."""
    old = versions(spark, name)
    db, table = _full_name(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {quoted(f'{db}.{table}')}")
    for physical in old:
        if purge:
            _discard(spark, physical, _location(spark, physical))
        else:
            spark.sql(f"DROP TABLE IF EXISTS {quoted(physical)}")


def evolve(spark: SparkSession, name: str, new_schema: StructType, rewrite: bool = False) -> None:
    """Add the new columns of `new_schema`; old rows hold NULL there.

    Dropped, retyped or reordered columns need `rewrite=True` and are written as a new version.
    """
    props = _properties(spark, name)
    old = spark.table(name).schema
    if [f.dataType for f in new_schema.fields[: len(old)]] == [f.dataType for f in old] and (
        new_schema.names[: len(old)] == old.names
    ):
        added = new_schema.fields[len(old) :]
        if added:
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {quoted(props[TABLE_KEY])} ADD COLUMNS ({ddl})")
        publish(
            spark,
            name,
            props[TABLE_KEY],
            props[LOCATION_KEY],
            new_schema.names,
            props[FORMAT_KEY],
            _partitions(props),
            props[ROOT_KEY],
        )
        return
    if not rewrite:
        raise ValueError(f"{name}: only added columns are possible without rewrite=True")
    base = base_of(spark, name)
    table = spark.table(name)
    kept = [
        (F.col(f.name) if f.name in old.names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in new_schema.fields
    ]
    write_table(table.select(*kept), name, "replace", base=base)


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number differs between the sides, with `n = left - right`; one shuffle."""
    sides = [without_maps(left).withColumn("_side", F.lit(1)), without_maps(right).withColumn("_side", F.lit(-1))]
    counted = sides[0].unionByName(sides[1]).groupBy(*left.columns).agg(F.sum("_side").alias("n")).filter(F.col("n") != 0)
    return with_maps(counted, left.schema)


def without_maps(df: DataFrame) -> DataFrame:
    """`df` with every MAP column as its entries in the order of their keys, which can be compared and grouped."""
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    return df.withColumns({c: F.array_sort(F.map_entries(F.col(f"`{c}`"))) for c in maps}) if maps else df


def with_maps(df: DataFrame, schema: StructType) -> DataFrame:
    """Undoes `without_maps` for the columns that are maps in `schema`."""
    maps = [f.name for f in schema.fields if f.dataType.typeName() == "map" and f.name in df.columns]
    return df.withColumns({c: F.map_from_entries(F.col(f"`{c}`")) for c in maps}) if maps else df


def fingerprints(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by, n, xor, total`: number of rows and two order-free combinations of their hashes, per value of `by`.

    Rows do not move: every task sends one row per value of `by`. Equal multisets have equal
    fingerprints; the reverse holds but for a chance of about 2^-64.
    """
    flat = without_maps(df)
    hashed = flat.select(*by, F.xxhash64(*[F.col(f"`{c}`") for c in flat.columns]).alias("_h"))
    total = F.sum(F.col("_h").cast("decimal(20,0)")).cast("string").alias("total")
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor("_h").alias("xor"), total)


def differing_partitions(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values of `by` whose rows are not the same multiset on both sides; one row without columns in use if `by` is empty."""
    sides = fingerprints(left, by).withColumn("_side", F.lit(1)).unionByName(fingerprints(right, by).withColumn("_side", F.lit(-1)))
    odd = sides.groupBy(*by, "n", "xor", "total").agg(F.sum("_side").alias("_odd")).filter(F.col("_odd") != 0)
    return odd.select(*by).distinct() if by else odd.select("n").limit(1)


def verify_write(expected: DataFrame, name: str, key: Sequence[str] | None = None, exact: bool = False) -> int:
    """Fail unless table `name` holds as many rows as `expected`; returns the count.

    `key` compares the key columns as multisets as well, `exact` all columns. That is done by
    fingerprints, per partition of the table where its partition columns are compared: both sides are
    read once and nothing is shuffled but a row per partition. Only the rows of partitions that differ are compared one by one.
    """
    spark = expected.sparkSession
    table = spark.table(name)
    wanted, found = expected.count(), table.count()
    if wanted != found:
        raise RuntimeError(f"{name}: expected {wanted} rows, found {found}")
    columns = expected.columns if exact else list(key or ())
    if columns:
        parts = _partitions(view_properties(spark, name)) if view_properties(spark, name).get(TABLE_KEY) else []
        by = [p for p in parts if p in columns]
        left, right = expected.select(*columns), table.select(*columns)
        odd = differing_partitions(left, right, by)
        values = [tuple(r) for r in odd.limit(LISTED + 1).collect()]
        if values and by and len(values) <= LISTED:
            # by literals, so that the scans prune all other partitions
            same = [reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(by, row)]) for row in values]
            left, right = (side.filter(reduce(lambda a, b: a | b, same)) for side in (left, right))
        if values and multiset_diff(left, right).limit(1).count():
            raise RuntimeError(f"{name}: rows differ in {columns}")
    return found


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = 12) -> Column:
    """Bits of the scaled values of `columns` in turns, the highest first; NULL sorts with the least.

    Rows near each other in this order are near in every column, so files cut along it can be skipped
    by filters on any of them. Numbers, dates and timestamps; one aggregate over `df` finds their ends.
    """

    def number(c: str) -> Column:
        kind, col = df.schema[c].dataType.typeName(), F.col(f"`{c}`")
        if kind in ("timestamp", "timestamp_ntz"):
            return F.unix_micros(col.cast("timestamp")).cast("double")
        return (F.unix_date(col) if kind == "date" else col).cast("double")

    ends = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("least", F.min), ("most", F.max))]).first()
    scaled = []
    for i, c in enumerate(columns):
        least, most = ends[f"least{i}"], ends[f"most{i}"]
        span = (most - least) if least is not None and most > least else 1.0
        level = F.floor((number(c) - F.lit(least or 0.0)) / F.lit(span) * ((1 << bits) - 1))
        scaled.append(F.coalesce(level, F.lit(0)).cast("bigint"))
    out = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for level in scaled:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(level, bit).bitwiseAND(F.lit(1)))
    return out


def compact(spark: SparkSession, name: str, target_bytes: int = 256 * 1024 * 1024, cluster_by: Sequence[str] = ()) -> int:
    """Bring the files of `name` to about `target_bytes`; returns how many files were asked for.

    Partitions whose files are well sized (all within a factor of two, or a single smaller one) are
    left as they are; the others are rewritten in place, so a reader may see the table partition by
    partition. A table without partitions is left alone or written anew as a version. Every partition
    value gets as many files as its share of the bytes needs, so a value with a third of all rows is
    written by many tasks. With `cluster_by`, rows are put into files by the interleaved bits of those
    columns, and partitions of several files are always rewritten.
    """
    base = base_of(spark, name)
    props = _properties(spark, name)
    parts = _partitions(props)
    sizes = list_files(spark, props[LOCATION_KEY]).select("length", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    wrong = F.max(F.col("length")) > 2 * target_bytes
    small = F.count_if(F.col("length") < target_bytes / 2)
    crowded = (F.count("*") > 1) & (small > 0) if not cluster_by else F.count("*") > 1
    folders = sizes.groupBy("folder").agg(F.sum("length").alias("bytes"), (wrong | crowded).alias("wrong")).filter("wrong")
    wanted = F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("int").alias("files")
    # metadata: one row per partition to rewrite
    todo = folders.select("folder", wanted).collect()
    if not todo:
        return 0
    table = current(spark, name)
    order = interleaved(table, cluster_by) if cluster_by else None
    asked = sum(r["files"] for r in todo)
    if not parts:
        spread = table.repartition(asked) if order is None else table.withColumn("_order", order).repartitionByRange(asked, "_order").sortWithinPartitions("_order").drop("_order")
        _write_version(spread, name, props[ROOT_KEY], props[FORMAT_KEY], parts, rebalance=False, base=base)
        return asked
    first = [0, *accumulate(r["files"] for r in todo)]
    place = spark.createDataFrame([(r["folder"], r["files"], at) for r, at in zip(todo, first)], "_folder string, _files int, _first int")
    # as listings write it: names as they are, one slash behind the scheme of local files
    written = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(F.regexp_replace(written, "^file:/+", "file:/"), r"^(.*)/[^/]*$", 1)
    # the few partitions to rewrite are known by folder; the values of their rows prune the scan
    values = [tuple(r) for r in table.withColumn("_folder", folder).join(F.broadcast(place), "_folder").select(*parts).distinct().limit(LISTED + 1).collect()]
    chosen = table.withColumn("_folder", folder)
    if len(values) <= LISTED:
        same = [reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, row)]) for row in values]
        chosen = chosen.filter(reduce(lambda a, b: a | b, same))
    path = scratch_path(spark, "compact")
    try:
        # rows of a scan keep their order when a task is re-run, so the deal is repeatable
        deal = (F.col("_first") + F.pmod(F.monotonically_increasing_id(), F.col("_files"))).cast("int") if order is None else order
        dealt = chosen.join(F.broadcast(place), "_folder").withColumn("_deal", deal).drop("_folder")
        stored = materialise(dealt, path)
        if order is None:
            spread = stored.repartitionById(asked, F.col("_deal"))
        else:
            spread = stored.repartitionByRange(asked, *parts, "_deal").sortWithinPartitions(*parts, "_deal")
        if base_of(spark, name) != base:
            raise Conflict(f"{name} has changed meanwhile")
        _save(spread.select(*table.columns), props[FORMAT_KEY], props[LOCATION_KEY], parts, False, mode="overwrite")
        spark.catalog.refreshTable(props[TABLE_KEY])
        spark.catalog.refreshTable(name)
    finally:
        delete_path(spark, path)
    return asked


def convert(spark: SparkSession, name: str, fmt: str) -> None:
    """Rewrite `name` in another file format."""
    if fmt.lower() not in FILE_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    base = base_of(spark, name)
    write_table(spark.table(name), name, "replace", fmt=fmt, base=base)
