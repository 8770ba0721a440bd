import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakekit.operators import buckets, merge, tables
from lakekit.session import materialise
from lakekit.sources.catalog import view_properties
from lakekit.streaming.upsert import foreach_batch_upsert

SCHEMA = "k int, t int, v string"


@pytest.fixture
def make(spark):
    return lambda *r, schema=SCHEMA: spark.createDataFrame(list(r), schema)


def files_of(spark, name):
    """Every data file of the table with its time of change, in nanoseconds."""
    place = view_properties(spark, name)[tables.LOCATION_KEY].removeprefix("file:")
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(place) for f in names if f.endswith(".parquet") and ".spark-staging" not in d
    }


def test_a_batch_rewrites_only_its_buckets(spark, root, name, make):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=64)
    table = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("t"), F.lit("old").alias("v"))
    assert buckets.upsert(table, name) == 64
    before = files_of(spark, name)
    assert spark.table(name).columns == ["k", "t", "v"]
    for batch in ([5], [5, 77], [123_456]):
        touched = buckets.upsert(make(*[(k, 2, "new") for k in batch]), name)
        after = files_of(spark, name)
        written = {f for f in after if after[f] != before.get(f)}
        # so the bytes written follow the batch: one file of 64 for each of its keys
        assert touched == len(written) == len(set(batch)) and len(after) == 64
        assert len(set(before) & set(after)) == 64 - touched
        assert sum(map(os.path.getsize, written)) < len(batch) * 3 * sum(map(os.path.getsize, after)) / 64
        before = after
    assert spark.table(name).count() == 20_001
    assert rows(spark.table(name).filter("v = 'new'"), "k") == [(5,), (77,), (123_456,)]


def test_newest_wins_whatever_the_order(spark, root, name, make):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=4)
    buckets.upsert(make((1, 5, "a"), (2, 1, "x"), (None, 1, "n")), name, newest_by="t")
    buckets.upsert(make((1, 4, "older"), (2, 2, "y"), (2, 3, "z"), (None, 2, "m"), (3, 1, "b"), (3, 1, "a")), name, newest_by="t")
    assert rows(spark.table(name)) == [(None, 2, "m"), (1, 5, "a"), (2, 3, "z"), (3, 1, "a")]
    buckets.upsert(make(), name, newest_by="t")
    assert spark.table(name).count() == 4


def test_removals_may_empty_a_bucket(spark, root, name, make):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=16)
    buckets.upsert(make(*[(k, 0, "a") for k in range(8)]), name)
    gone = make(*[(k, 1, "b", k != 3) for k in range(9)], schema=SCHEMA + ", gone boolean")
    buckets.upsert(gone, name, delete_flag="gone")
    assert rows(spark.table(name)) == [(3, 1, "b")]
    assert len(files_of(spark, name)) == 1


def test_an_interrupted_upsert_is_completed(spark, root, name, make, monkeypatch):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=8)
    buckets.upsert(make(*[(k, 0, "a") for k in range(50)]), name)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(buckets, "_install", stop)
        with pytest.raises(RuntimeError):
            buckets.upsert(make((1, 1, "b")), name)
    assert rows(spark.table(name).filter("k = 1")) == [(1, 0, "a")]
    assert buckets.recover(spark, name) and not buckets.recover(spark, name)
    assert rows(spark.table(name).filter("k = 1")) == [(1, 1, "b")] and spark.table(name).count() == 50


def test_full_buckets_are_divided(spark, root, name, make):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=2)
    table = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("t"), F.lit("v").alias("v"))
    buckets.upsert(table, name, most_rows=100)
    count = int(view_properties(spark, name)[buckets.COUNT_KEY])
    assert count >= 16 and spark.table(name).count() == 1000 and spark.table(name).columns == ["k", "t", "v"]
    fullest = tables.current(spark, name).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert fullest <= 100 and buckets.bucket_keys(spark, name) == ["k"]
    assert buckets.upsert(make((7, 2, "w")), name) == 1
    assert rows(spark.table(name).filter("k = 7")) == [(7, 2, "w")]


def test_stream_batches_go_to_buckets_and_replays_change_nothing(spark, root, name, make):
    buckets.create_keyed(spark, name, make().schema, root, ["k"], buckets=32)
    sink = foreach_batch_upsert(name, ["k"], newest_by="t")
    sink(make(*[(k, 5, "a") for k in range(500)]), 0)
    before = files_of(spark, name)
    sink(make((2, 6, "y")), 1)
    after = files_of(spark, name)
    assert len({f for f in after if after[f] != before.get(f)}) == 1
    sink(make((2, 9, "replayed with other rows")), 1)
    assert files_of(spark, name) == after and len(tables.versions(spark, name)) == 1
    assert rows(spark.table(name).filter("k = 2")) == [(2, 6, "y")]


def test_bad_targets(spark, root, name, make):
    with pytest.raises(ValueError):
        buckets.create_keyed(spark, name, make().schema, root, ["absent"])
    tables.create_table(spark, name, make().schema, root)
    with pytest.raises(ValueError):
        buckets.upsert(make(), name)
    assert buckets.bucket_keys(spark, name) == []


def test_merge_touches_its_partitions_by_default(spark, root, name, make):
    tables.write_table(make((1, 1, "a"), (2, 2, "b"), (3, 3, "c")), name, "create", root, partition_by=["t"])
    before = files_of(spark, name)
    merge.merge_into(materialise(make((1, 1, "z")), f"{root}/in"), name, ["k", "t"])
    after = files_of(spark, name)
    assert len(set(before) & set(after)) == 2 and rows(spark.table(name), "k", "v") == [(1, "z"), (2, "b"), (3, "c")]
    merge.merge_into(materialise(make((1, 1, "y")), f"{root}/in2"), name, ["k", "t"], touched_only=False)
    assert not set(files_of(spark, name)) & set(after)
