"""Keyed upsert per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.buckets import bucket_keys, upsert
from ..operators.merge import merge_by_key, one_per_key
from ..operators.tables import aligned, base_of, expire_versions, write_table
from ..sources.catalog import view_properties

BATCH_KEY = "lakekit.batch"


def foreach_batch_upsert(target: str, keys: Sequence[str], newest_by: str | None = None):
    """Function for `foreachBatch` that upserts every batch into table `target`.

    With `newest_by` the newest row per key wins, also against the rows already there, so the
    result does not depend on the order of arrival. Without it a batch replaces the keys it has.
    The batch id is published together with the rows: a replayed batch changes nothing.

    A target made by `create_keyed` over the same keys has only the buckets rewritten that a batch has
    keys for. Any other table is written anew for every batch; its version before stays for its
    readers, older ones are expired.
    """
    keys = list(keys)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = int(view_properties(spark, target).get(BATCH_KEY, "-1"))
        if batch_id <= done:
            return
        if bucket_keys(spark, target) == keys:
            upsert(batch, target, newest_by, properties={BATCH_KEY: str(batch_id)})
            return
        base = base_of(spark, target)
        table = spark.table(target)
        incoming = aligned(batch, table.columns)
        if newest_by is not None:
            merged = one_per_key(table.unionByName(incoming), keys, newest_by)
        else:
            merged = merge_by_key(table, one_per_key(incoming, keys), keys)
        write_table(merged, target, "replace", properties={BATCH_KEY: str(batch_id)}, base=base)
        expire_versions(spark, target, keep=2)

    return process
