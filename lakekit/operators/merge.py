"""Key-wise writes: append what is absent, merge, export one document per id.

Keys compare null-safe. Nothing here groups rows into lists: duplicates are resolved by
aggregates that combine before the shuffle, and the joins have a side that is unique on its
keys, so adaptive execution can split a hot key on the other side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path
from ..sources.catalog import physical_name, provider
from .tables import aligned, base_of, current, overwrite, partition_list, with_maps, without_maps, write_table

# up to so many partition values are written into the filter, so that the scan prunes by them
LISTED_PARTITIONS = 1000
# up to so many new rows Spark may send their keys to the table's rows; more are compared in one shuffle
FEW_ROWS = 100_000


def _match(left: Sequence[str], right: Sequence[str]) -> Column:
    pairs = [F.col(l).eqNullSafe(F.col(r)) for l, r in zip(left, right)]
    return reduce(lambda a, b: a & b, pairs)


def _newest_first(df: DataFrame, column: str) -> Column | None:
    """A value that falls as `column` rises, NULL last; None when the type has no exact inverse."""
    kind, col = df.schema[column].dataType.typeName(), F.col(column)
    if kind == "timestamp_ntz":
        number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
    elif kind == "timestamp":
        number = F.unix_micros(col)
    elif kind == "date":
        number = F.unix_date(col)
    elif kind in ("byte", "short", "integer", "long"):
        number = col
    else:
        return None
    return F.struct(col.isNull().alias("_null"), F.bitwise_not(number.cast("bigint")).alias("_falling"))


def one_per_key(df: DataFrame, keys: Sequence[str], newest_by: str | None = None) -> DataFrame:
    """One row per key: the newest by `newest_by`, on a tie the smallest remaining row.

    An aggregate and no window: a key with a third of all rows is reduced to one row on every map
    task, no task sorts its rows, and about one row per key and task is shuffled. An order column
    without an exact inverse (text, floating point) takes two such steps. Maps are compared by
    their entries in the order of their keys.
    """
    if any(f.dataType.typeName() == "map" for f in df.schema.fields):
        return with_maps(one_per_key(without_maps(df), keys, newest_by), df.schema)
    rest = [c for c in df.columns if c not in keys and c != newest_by]
    packed = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    falling = _newest_first(df, newest_by) if newest_by else F.lit(0)
    if falling is not None:
        kept = F.struct(*rest, *([newest_by] if newest_by else []), F.lit(0).alias("_none"))
        first = df.groupBy(*keys).agg(F.min(F.struct(falling.alias("_order"), kept.alias("_row"))).alias("_best"))
        return first.select(*[F.col(c) if c in keys else F.col(f"_best._row.{c}").alias(c) for c in df.columns])
    per_order = df.groupBy(*keys, newest_by).agg(F.min(packed).alias("_row"))
    newest = per_order.groupBy(*keys).agg(
        F.max(F.struct(F.col(newest_by).alias("_order"), F.col("_row"))).alias("_best")
    )

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        return F.col("_best._order").alias(c) if c == newest_by else F.col(f"_best._row.{c}").alias(c)

    return newest.select(*[pick(c) for c in df.columns])


def absent_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `incoming` whose key `existing` lacks; duplicates collapse to the smallest row."""
    fresh = one_per_key(incoming, keys)
    taken = [f"_k{i}" for i in range(len(keys))]
    return fresh.join(_met(existing, fresh, keys, taken), _match(keys, taken), "left_anti")


def _met(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], taken: Sequence[str]) -> DataFrame:
    """Keys of `existing` that `incoming` has, as columns `taken`.

    When Spark broadcasts the incoming keys, `existing` is scanned where it is; only what is met moves.
    """
    wanted = incoming.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)])
    held = existing.select(*[F.col(k).alias(t) for k, t in zip(keys, taken)])
    return held.join(wanted, _match(taken, [f"_w{i}" for i in range(len(keys))]), "left_semi")


def absent_keys(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `incoming` that `existing` lacks, as columns `_k0`, `_k1` and so on.

    One aggregate over the keys of both sides, combined before the only shuffle; NULL is a key like any other.
    """
    taken = [f"_k{i}" for i in range(len(keys))]
    held, wanted = (
        df.select(*[F.col(k).alias(t) for k, t in zip(keys, taken)], F.lit(there).alias("_there"))
        for df, there in ((existing, True), (incoming, False))
    )
    return held.unionByName(wanted).groupBy(*taken).agg(F.max("_there").alias("_there")).filter(~F.col("_there")).drop("_there")


def _inserted(fresh: DataFrame, name: str) -> int:
    """Append `fresh` to `name`; returns how many rows it had."""
    spark, added = fresh.sparkSession, Observation()
    fresh.observe(added, F.count(F.lit(1)).alias("n")).write.insertInto(physical_name(spark, name))
    spark.catalog.refreshTable(name)
    return added.get["n"]


def append_absent(df: DataFrame, name: str, keys: Sequence[str]) -> int:
    """Append the rows of `df` whose key is absent from table `name`; returns how many.

    `df` is worked out once: for an empty table straight into it, else into the shared folder. Rows of
    the table whose first key is outside the range of the new ones cannot match and are not read, as far
    as files and partitions tell. Of many new rows the keys are compared first, and whole rows
    move only when some of them are absent.
    """
    spark = df.sparkSession
    table = current(spark, name)
    rows = aligned(df, table.columns)
    if table.isEmpty():
        return _inserted(one_per_key(rows, keys), name)
    path = scratch_path(spark, "append")
    ranged = table.schema[keys[0]].dataType.typeName() not in ("map", "array", "struct", "variant", "binary", "double", "float")
    ends = [F.min(keys[0]).alias("least"), F.max(keys[0]).alias("most")] if ranged else []
    seen = Observation()
    try:
        # the ends are observed while the rows are written
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), *ends)
        incoming = materialise(counted, f"{path}/rows")
        if not seen.get["n"]:
            return 0
        if ranged and seen.get["least"] is not None:
            kind = table.schema[keys[0]].dataType
            least, most = (F.lit(seen.get[e]).cast(kind) for e in ("least", "most"))
            table = table.filter(F.col(keys[0]).isNull() | F.col(keys[0]).between(least, most))
        alike = all(incoming.schema[k].dataType == table.schema[k].dataType for k in keys)
        if seen.get["n"] <= FEW_ROWS or not alike:
            return _inserted(absent_rows(table, incoming, keys), name)
        missing = Observation()
        absent = materialise(absent_keys(table, incoming, keys).observe(missing, F.count(F.lit(1)).alias("n")), f"{path}/keys")
        if not missing.get["n"]:
            return 0
        return _inserted(one_per_key(incoming.join(absent, _match(keys, absent.columns), "left_semi"), keys), name)
    finally:
        delete_path(spark, path)


def merge_by_key(
    target: DataFrame, source: DataFrame, keys: Sequence[str], delete_flag: str | None = None
) -> DataFrame:
    """Target after a merge: matched rows take the source's values, new keys are inserted.

    A source row with a true `delete_flag` deletes its match and is never inserted. A key twice in
    the source fails the query. Target rows without match are unchanged.

    A left join plus an anti join rather than one full outer join: a source below Spark's
    broadcast size then leaves the target unshuffled, and above it a hot target key can be split.
    The anti join is with those keys of the target that the source has, which move and no others.
    """
    columns = target.columns
    values = [c for c in columns if c not in keys]
    missing = [c for c in columns if c not in source.columns]
    if missing:
        raise ValueError(f"source lacks {missing}")
    deleted = F.coalesce(F.col(delete_flag).cast("boolean"), F.lit(False)) if delete_flag else F.lit(False)
    packed = source.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*values, F.lit(1).alias("_hit")).alias("_new"),
        deleted.alias("_deleted"),
    )
    taken = [f"_k{i}" for i in range(len(keys))]
    grouped = packed.groupBy(*taken).agg(
        F.count("*").alias("_n"), F.first("_new").alias("_new"), F.first("_deleted").alias("_deleted")
    )
    twice = F.raise_error(F.lit(f"duplicate source key in {list(keys)}"))
    unique = grouped.select(
        *taken, F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(F.col("_deleted")).alias("_deleted"), "_new"
    )
    hit = F.col("_new").isNotNull()
    updated = (
        target.join(unique, _match(keys, taken), "left")
        .filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
        .select(
            *[
                F.col(c) if c in keys else F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
                for c in columns
            ]
        )
    )
    there = [f"_t{i}" for i in range(len(keys))]
    wanted = unique.filter(~F.col("_deleted"))
    present = _met(target, wanted.select(*[F.col(t).alias(k) for k, t in zip(keys, taken)]), keys, there)
    inserted = (
        wanted.join(present, _match(taken, there), "left_anti")
        .select(
            *[
                F.col(f"_k{list(keys).index(c)}").alias(c) if c in keys else F.col(f"_new.{c}").alias(c)
                for c in columns
            ]
        )
    )
    return updated.unionByName(inserted)


def merge_into(
    df: DataFrame, name: str, keys: Sequence[str], delete_flag: str | None = None, touched_only: bool | None = None
) -> None:
    """Merge `df` into table `name`.

    `touched_only` reads and rewrites only the partitions that `df` has rows for, which is enough
    when the partition columns are among the keys and then is the default. It works in place, so a
    reader may see it partition by partition; with `touched_only=False` readers see the old or the
    new rows, never a mixture. The whole table is still rewritten when a partition would lose all its
    rows. `df` is worked out once, into the shared folder.
    """
    spark = df.sparkSession
    base = base_of(spark, name)
    table = current(spark, name)
    flag = [delete_flag] if delete_flag else []
    missing = [c for c in table.columns if c not in df.columns]
    if missing:
        raise ValueError(f"source lacks {missing}")
    aligned(df, table.columns, flag)
    if touched_only is None:
        parts = partition_list(spark, name)
        touched_only = bool(parts) and set(parts) <= set(keys)
    path = scratch_path(spark, "merge")
    try:
        source = materialise(df, f"{path}/source")
        if touched_only and _merge_touched(source, table, name, keys, delete_flag, f"{path}/merged"):
            return
        write_table(merge_by_key(table, source, keys, delete_flag), name, "replace", base=base)
    finally:
        delete_path(spark, path)


def _merge_touched(
    df: DataFrame, table: DataFrame, name: str, keys: Sequence[str], delete_flag: str | None, path: str
) -> bool:
    """False, and nothing done, when a partition would lose all its rows; `df` must be stored."""
    spark = df.sparkSession
    parts = partition_list(spark, name)
    if not parts or not set(parts) <= set(keys):
        raise ValueError(f"touched_only needs the partition columns of {name} among the keys")
    values = df.select(*parts).distinct()
    # partition values are metadata: few rows reach the driver
    touched = [tuple(r) for r in values.limit(LISTED_PARTITIONS + 1).collect()]
    if not touched:
        return True
    names = [f"_p{i}" for i in range(len(parts))]
    of_touched = values.select(*[F.col(p).alias(n) for p, n in zip(parts, names)])
    affected = table.join(of_touched, _match(parts, names), "left_semi")
    if len(touched) <= LISTED_PARTITIONS:
        # the same rows, by literals, so that the scan prunes all other partitions

        def is_one(row: tuple) -> Column:
            return reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, row)])

        affected = table.filter(reduce(lambda a, b: a | b, [is_one(v) for v in touched]))
    merged = materialise(merge_by_key(affected, df, keys, delete_flag), path)
    emptied = affected.select(*parts).distinct().exceptAll(merged.select(*parts).distinct())
    whole = emptied.limit(1).count() == 0
    if whole:
        overwrite(merged, name, "dynamic")
    return whole


def one_document_per_id(df: DataFrame, id_col: str, newest_by: str | None = None) -> DataFrame:
    """One row per id; a NULL id fails the query."""
    no_id = F.raise_error(F.lit(f"NULL in id column {id_col}"))
    kind = df.schema[id_col].dataType
    checked = df.withColumn(id_col, F.when(F.col(id_col).isNull(), no_id.cast(kind)).otherwise(F.col(id_col)))
    return one_per_key(checked, [id_col], newest_by)


def keyed_export(
    df: DataFrame,
    target: str,
    id_col: str,
    mode: str = "replace",
    fmt: str = "json",
    newest_by: str | None = None,
    root: str | None = None,
    options: Mapping[str, str] | None = None,
) -> None:
    """One document per id into `target`: `mode` replaces everything or upserts by id.

    File formats write a registered table. Any other format is a connector that resolves ids by
    itself and gets the de-duplicated rows with `options`.
    """
    if mode not in ("replace", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    documents = one_document_per_id(df, id_col, newest_by)
    if fmt not in ("json", "parquet", "orc", "csv"):
        how = "overwrite" if mode == "replace" else "append"
        documents.write.format(fmt).options(**dict(options or {})).mode(how).save(target)
        return
    spark = df.sparkSession
    base = None
    if mode == "upsert" and spark.catalog.tableExists(target):
        base = base_of(spark, target)
        table = current(spark, target)
        documents = merge_by_key(table, aligned(documents, table.columns), [id_col])
        fmt = provider(spark, target)
    write_table(documents, target, "create_or_replace", root=root, fmt=fmt, base=base)
