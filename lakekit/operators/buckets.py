"""Keyed tables: one row per key, in hash buckets, so that a batch rewrites only the buckets it has keys for.

The bucket is a stored partition column that readers of the table do not see. An upsert reads the
buckets of its keys, merges, and overwrites those partitions; all other files stay as they are. Keys
are unique and hashed, so buckets are even and grow together: once they hold more than `MOST_ROWS`
rows, the table is written anew with more buckets, which happens once per doubling.

What an upsert is about to install is noted in the table's properties first. A run that ends in the
middle is completed from there by the next one, before it reads anything. Readers may see a batch
bucket by bucket.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import delete_path, materialise, scratch_path
from ..sources.catalog import quoted, view_properties
from . import tables
from .merge import merge_by_key, one_per_key

BUCKET = "_bucket"
KEYS_KEY, COUNT_KEY, PENDING_KEY = "lakekit.bucket_keys", "lakekit.buckets", "lakekit.bucket_pending"
MOST_ROWS = 4_000_000


def bucket_keys(spark: SparkSession, name: str) -> list[str]:
    """Key columns of a keyed table; empty for any other."""
    return json.loads(view_properties(spark, name).get(KEYS_KEY) or "[]")


def _bucket(keys: Sequence[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def create_keyed(
    spark: SparkSession, name: str, schema: StructType, root: str, keys: Sequence[str], buckets: int = 16, fmt: str | None = None
) -> None:
    """Empty keyed table."""
    missing = [k for k in keys if k not in schema.names]
    if missing or not keys or BUCKET in schema.names or buckets < 1:
        raise ValueError(f"bad keys {list(keys)}, columns or number of buckets")
    stored = StructType([*schema.fields]).add(BUCKET, IntegerType())
    tables.create_table(spark, name, stored, root, [BUCKET], fmt)
    own = view_properties(spark, name)
    tables.publish(
        spark, name, own[tables.TABLE_KEY], own[tables.LOCATION_KEY], schema.names, own[tables.FORMAT_KEY], [BUCKET], root,
        {KEYS_KEY: json.dumps(list(keys)), COUNT_KEY: str(buckets), PENDING_KEY: ""},
    )


def _set(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    text = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"ALTER VIEW {quoted(name)} SET TBLPROPERTIES ({text})")


def _buckets_of(rows: DataFrame) -> list[int]:
    """At most one number per bucket of the table."""
    return [r[0] for r in rows.select(BUCKET).distinct().collect()]


def _install(spark: SparkSession, name: str, path: str) -> None:
    """Puts the merged buckets below `path` in place of those that the table has; may be done again."""
    own = view_properties(spark, name)
    kind = tables.current(spark, name).schema
    merged = spark.read.schema(kind).parquet(f"{path}/merged")
    left = set(_buckets_of(merged))
    if left:
        tables.overwrite(merged, name, "dynamic")
    for bucket in set(_buckets_of(spark.read.parquet(f"{path}/source"))) - left:
        spark.sql(f"ALTER TABLE {quoted(own[tables.TABLE_KEY])} DROP IF EXISTS PARTITION ({BUCKET} = {bucket})")
        delete_path(spark, f"{own[tables.LOCATION_KEY]}/{BUCKET}={bucket}")
    spark.catalog.refreshTable(own[tables.TABLE_KEY])
    spark.catalog.refreshTable(name)


def recover(spark: SparkSession, name: str) -> bool:
    """Completes an upsert that was interrupted while it was installed; whether there was one."""
    path = view_properties(spark, name).get(PENDING_KEY)
    if path:
        _install(spark, name, path)
        _set(spark, name, {PENDING_KEY: ""})
        delete_path(spark, path)
    return bool(path)


def upsert(
    df: DataFrame,
    name: str,
    newest_by: str | None = None,
    delete_flag: str | None = None,
    properties: dict[str, str] | None = None,
    most_rows: int = MOST_ROWS,
) -> int:
    """Upsert `df` into keyed table `name`; returns how many buckets were rewritten.

    With `newest_by` the newest row per key wins, also against the rows already there, on a tie the
    smallest. Without it the rows of `df` replace those of the same key, and a true `delete_flag`
    removes its key; of equal keys in `df` the smallest row counts. Doing the same again changes
    nothing. `properties` are set once the rows are in place.
    """
    if newest_by and delete_flag:
        raise ValueError("rows that only delete have no newest version")
    spark = df.sparkSession
    keys = bucket_keys(spark, name)
    if not keys:
        raise ValueError(f"{name} is not a keyed table")
    recover(spark, name)
    count = int(view_properties(spark, name)[COUNT_KEY])
    table = tables.current(spark, name)
    columns = [c for c in table.columns if c != BUCKET]
    flag = [delete_flag] if delete_flag else []
    tables.aligned(df, columns, flag)
    path = scratch_path(spark, "upsert")
    done = False
    try:
        single = one_per_key(df.select(*columns, *flag), keys, newest_by)
        source = materialise(single.withColumn(BUCKET, _bucket(keys, count)), f"{path}/source")
        touched = _buckets_of(source)
        if touched:
            affected = table.filter(F.col(BUCKET).isin(touched))
            within = [*keys, BUCKET]
            if newest_by:
                merged = one_per_key(affected.unionByName(source), within, newest_by)
            else:
                merged = merge_by_key(affected, source, within, delete_flag)
            merged = materialise(merged.select(*table.columns), f"{path}/merged")
            fullest = merged.groupBy(BUCKET).count().agg(F.max("count")).first()[0] or 0
            _set(spark, name, {PENDING_KEY: path})
            done = True
            recover(spark, name)
            if fullest > most_rows:
                grow(spark, name, count * 2 ** max(1, (2 * fullest // most_rows).bit_length() - 1))
        if properties:
            _set(spark, name, properties)
        return len(touched)
    finally:
        # what is noted as pending stays until it is installed
        if not done:
            delete_path(spark, path)


def grow(spark: SparkSession, name: str, buckets: int) -> None:
    """Write a keyed table anew with another number of buckets, as a new version."""
    recover(spark, name)
    keys = bucket_keys(spark, name)
    base = tables.base_of(spark, name)
    shown = spark.table(name)
    tables.write_table(
        shown.withColumn(BUCKET, _bucket(keys, buckets)), name, "replace",
        properties={COUNT_KEY: str(buckets)}, base=base, shown=shown.columns,
    )
    tables.expire_versions(spark, name, keep=2)
