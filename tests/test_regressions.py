"""Failures seen in practice that must not come back."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lakekit.operators import descriptors, tables
from lakekit.sources.catalog import provider

KV = StructType().add("k", IntegerType()).add("v", StringType())


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def test_f1_a_path_is_no_table_name(spark, root):
    names = spark.createDataFrame([("delta.s3a://bucket/t",), ("silver_t-1",)], "n string")
    assert [r.ok for r in descriptors.valid_names(names, "n").collect()] == [False, True]
    with pytest.raises(ValueError):
        tables.create_table(spark, "default.s3a://bucket/t", KV, root)


def test_f2_a_name_read_again_shows_the_new_version(spark, root, name):
    tables.bootstrap_empty(spark, name, KV, root)
    before = spark.table(name)
    assert before.count() == 0
    tables.write_table(kv(spark, (1, "a")), name, "replace")
    assert rows(spark.table(name)) == [(1, "a")]
    assert before.count() == 0  # the old version is still readable
    tables.append(kv(spark, (2, "b")), name)
    assert spark.table(name).count() == 2


@pytest.mark.parametrize("partition_by", [[], ["v"]])
def test_f3_what_was_committed_is_there(spark, root, name, partition_by):
    seed = spark.range(1000).select(F.col("id").cast("int").alias("k"), (F.col("id") % 3).cast("string").alias("v"))
    tables.write_table(seed, name, "create", root, partition_by=partition_by)
    assert tables.verify_write(seed, name, exact=True) == 1000


def test_create_over_an_identical_table_keeps_its_rows(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    tables.create_table(spark, name, KV, root, if_exists="reuse")
    assert spark.table(name).count() == 1


def test_a_rename_of_equal_arity_is_a_change(spark, root, name):
    tables.create_table(spark, name, KV, root)
    with pytest.raises(ValueError, match="column 1 name"):
        tables.create_table(spark, name, StructType().add("k", IntegerType()).add("w", StringType()), root, if_exists="reuse")


def test_an_explicit_format_counts(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root, fmt="json")
    assert provider(spark, name) == "json"


def test_a_failed_replace_keeps_the_old_rows_and_no_files(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    location = tables.view_properties(spark, name)[tables.LOCATION_KEY]
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("k"))
    with pytest.raises(Exception, match="boom"):
        tables.write_table(bad, name, "replace")
    assert rows(spark.table(name)) == [(1, "a")]
    assert tables.versions(spark, name) == [tables.physical_name(spark, name)]
    assert tables.view_properties(spark, name)[tables.LOCATION_KEY] == location


def test_a_foreign_table_is_left_alone(spark, root, name):
    spark.sql(f"CREATE TABLE {name} (k int) USING parquet LOCATION '{root}/foreign'")
    with pytest.raises(ValueError):
        tables.write_table(kv(spark, (1, "a")), name, "replace", root)
    with pytest.raises(ValueError):
        tables.truncate(spark, name)
    spark.sql(f"DROP TABLE {name}")


def test_a_name_that_looks_like_a_version_is_not_one(spark, root, name):
    tables.write_table(spark.range(1), name, "create", root)
    tables.write_table(spark.range(1), f"{name}__vx", "create", root)
    assert len(tables.versions(spark, name)) == 1
    tables.drop(spark, name, purge=True)
    assert spark.table(f"{name}__vx").count() == 1
