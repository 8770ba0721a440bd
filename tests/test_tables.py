import os
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lakekit.operators import descriptors, merge, tables
from lakekit.session import materialise
from lakekit.sources import catalog
from lakekit.sources.catalog import view_properties

KV = StructType().add("k", IntegerType()).add("v", StringType())


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def versions_on_disk(root, name):
    folder = f"{root}/{name.split('.')[1]}".removeprefix("file:")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


# --- create -------------------------------------------------------------------------------------


def test_bootstrap_is_readable_before_the_first_write(spark, root, name):
    tables.bootstrap_empty(spark, name, KV, root, ["v"])
    df = spark.table(name)
    assert df.count() == 0 and df.columns == ["k", "v"]
    tables.append(kv(spark, (1, "a")), name)
    assert rows(spark.table(name)) == [(1, "a")]


def test_create_never_wipes_rows(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    with pytest.raises(ValueError):
        tables.create_table(spark, name, KV, root)
    assert tables.create_table(spark, name, KV, root, if_exists="reuse") == "reused"
    assert spark.table(name).count() == 1
    with pytest.raises(ValueError, match="type"):
        tables.create_table(spark, name, StructType().add("k", StringType()).add("v", StringType()), root, if_exists="reuse")
    assert spark.table(name).count() == 1
    assert tables.create_table(spark, name, KV, root, if_exists="recreate") == "recreated"
    assert spark.table(name).count() == 0


def test_modes(spark, root, name):
    with pytest.raises(ValueError):
        tables.write_table(kv(spark), name, "replace", root)
    tables.write_table(kv(spark, (1, "a")), name, "create_or_replace", root)
    with pytest.raises(ValueError):
        tables.write_table(kv(spark), name, "create", root)
    tables.write_table(spark.range(2), name, "replace")
    assert rows(spark.table(name)) == [(0,), (1,)]


def test_only_identity_partitions(spark, root, name):
    with pytest.raises(ValueError):
        tables.create_table(spark, name, KV, root, partition_by=["year(k)"])


def test_format_is_an_argument(spark, root, name):
    before = spark.conf.get("spark.sql.sources.default")
    tables.write_table(kv(spark, (1, "a")), name, "create", root, fmt="ORC")
    assert catalog.provider(spark, name) == "orc"
    assert spark.conf.get("spark.sql.sources.default") == before
    assert tables.resolve_format("DELTA", "parquet", honour_explicit=False) == "parquet"
    assert tables.resolve_format(None, "Parquet") == "parquet"


# --- failed writes ------------------------------------------------------------------------------


def test_failed_write_leaves_nothing(spark, root, name):
    bad = spark.range(10).select(F.when(F.col("id") > 5, F.raise_error(F.lit("boom")).cast("int")).otherwise(1).alias("x"))
    with pytest.raises(Exception, match="boom"):
        tables.write_table(bad, name, "create", root)
    assert not spark.catalog.tableExists(name)
    assert versions_on_disk(root, name) == [] and tables.versions(spark, name) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(at=st.integers(0, 20))
def test_readers_see_old_or_new(spark, at):
    import uuid

    from lakekit.session import scratch_path

    name, root = f"default.t_{uuid.uuid4().hex[:12]}", scratch_path(spark, "test")
    tables.write_table(spark.range(3), name, "create", root)
    newer = spark.range(10).select(
        F.when(F.col("id") == at, F.raise_error(F.lit("boom")).cast("bigint")).otherwise(F.col("id") + 100).alias("id")
    )
    try:
        tables.write_table(newer, name, "replace")
        assert rows(spark.table(name)) == [(i + 100,) for i in range(10)] and at >= 10
    except Exception as error:
        assert "boom" in str(error) and at < 10
        assert rows(spark.table(name)) == [(0,), (1,), (2,)]


def test_count_mismatch_is_not_published(spark, root, name, monkeypatch):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    monkeypatch.setattr(tables, "_save", lambda df, fmt, location, *_, **__: df.write.parquet(location) or 99)
    with pytest.raises(RuntimeError, match="wrote 99"):
        tables.write_table(kv(spark, (2, "b")), name, "replace")
    assert rows(spark.table(name)) == [(1, "a")]


# --- overwrite, truncate, evolve ----------------------------------------------------------------


def test_truncate_keeps_metadata(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root, partition_by=["v"])
    tables.truncate(spark, name)
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["k", "v"]
    tables.append(kv(spark, (2, "b")), name)
    assert rows(spark.table(name)) == [(2, "b")]
    with pytest.raises(ValueError):
        tables.truncate(spark, "default.not_there")


def test_overwrite_dynamic_keeps_other_partitions(spark, root, name):
    tables.write_table(kv(spark, (1, "a"), (2, "b"), (3, None)), name, "create", root, partition_by=["v"])
    tables.overwrite(kv(spark, (9, "b"), (8, "new")), name, "dynamic")
    assert rows(spark.table(name)) == [(1, "a"), (3, None), (8, "new"), (9, "b")]


def test_overwrite_where_keeps_null_conditions(spark, root, name):
    tables.write_table(kv(spark, (1, "a"), (2, "b"), (None, "c")), name, "create", root)
    tables.overwrite(kv(spark, (7, "z")), name, "where", F.col("k") > 1)
    assert rows(spark.table(name)) == [(None, "c"), (1, "a"), (7, "z")]


def test_evolve(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    wider = StructType().add("k", IntegerType()).add("v", StringType()).add("extra", IntegerType())
    tables.evolve(spark, name, wider)
    assert rows(spark.table(name)) == [(1, "a", None)]
    dropped = StructType().add("v", StringType()).add("k", StringType())
    with pytest.raises(ValueError):
        tables.evolve(spark, name, dropped)
    tables.evolve(spark, name, dropped, rewrite=True)
    assert rows(spark.table(name)) == [("a", "1")]


def test_drop_and_versions(spark, root, name):
    tables.drop(spark, name)  # a missing table is no error
    for i in range(3):
        tables.write_table(spark.range(i + 1), name, "create_or_replace", root)
    assert len(tables.versions(spark, name)) == 3
    assert len(tables.expire_versions(spark, name)) == 2
    assert spark.table(name).count() == 3 and len(versions_on_disk(root, name)) == 1
    tables.drop(spark, name, purge=True)
    assert not spark.catalog.tableExists(name) and versions_on_disk(root, name) == []


def test_verify_write(spark, root, name):
    tables.write_table(kv(spark, (1, "a"), (2, "b")), name, "create", root)
    assert tables.verify_write(kv(spark, (2, "b"), (1, "a")), name, exact=True) == 2
    with pytest.raises(RuntimeError):
        tables.verify_write(kv(spark, (1, "a")), name)
    tables.verify_write(kv(spark, (1, "x"), (2, "b")), name, key=["k"])
    with pytest.raises(RuntimeError, match="differ"):
        tables.verify_write(kv(spark, (1, "x"), (2, "b")), name, exact=True)


def test_compact_keeps_rows_and_splits_a_hot_partition(spark, root, name):
    hot = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("p"))
    tables.write_table(hot.repartition(20), name, "create", root, partition_by=["p"])
    asked = tables.compact(spark, name, 2000)
    assert tables.verify_write(hot, name, exact=True) == 3000
    files = spark.table(name).select("p", F.input_file_name().alias("f")).distinct().groupBy("p").count()
    # the other five have one file each, which is small but alone
    assert dict(rows(files))["hot"] == asked > 1 and files.filter("p <> 'hot' and count > 1").count() == 0
    tables.compact(spark, name)
    assert spark.table(name).select(F.input_file_name()).distinct().count() == 6


def stamps(spark, name):
    place = view_properties(spark, name)[tables.LOCATION_KEY].removeprefix("file:")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}


def test_compact_leaves_good_files_alone(spark, root, name):
    good = spark.range(400).select("id", F.concat(F.lit("a b%/"), F.col("id") % 3).alias("p"))
    tables.write_table(good, name, "create", root, partition_by=["p"])
    before = stamps(spark, name)
    assert len(before) == 3 and tables.compact(spark, name) == 0 and stamps(spark, name) == before
    for i in range(3):
        tables.append(spark.range(i, i + 1).select("id", F.lit("a b%/1").alias("p")), name)
    assert len(stamps(spark, name)) == 6
    assert tables.compact(spark, name) == 1
    after = stamps(spark, name)
    # the crowded partition is one file again, those of the others are as they were
    assert len(after) == 3 and len(set(before.items()) & set(after.items())) == 2
    assert spark.table(name).count() == 403 and spark.table(name).filter("p = 'a b%/1'").count() == 136


@pytest.mark.parametrize("parts", [[], ["p"]])
def test_clustering_lets_filters_on_either_column_skip_files(spark, root, name, parts):
    from pyspark.sql.types import DateType

    grid = spark.range(10_000).select(
        F.col("id"), (F.col("id") % 100).alias("x"), F.date_add(F.lit("2024-01-01").cast(DateType()), F.floor(F.col("id") / 100).cast("int")).alias("y"), F.lit("one").alias("p")
    )
    tables.write_table(grid.repartition(8, F.xxhash64("id")), name, "create", root, partition_by=parts)
    size = sum(os.path.getsize(f) for f in stamps(spark, name))
    asked = tables.compact(spark, name, size // 16, cluster_by=["x", "y"])
    assert asked >= 12 and tables.verify_write(grid, name, exact=True) == 10_000
    ends = spark.table(name).groupBy(F.input_file_name()).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    day = F.date_add(F.lit("2024-01-01").cast(DateType()), 50)
    total = ends.count()
    assert ends.filter("a <= 10 and b >= 10").count() <= total / 2
    assert ends.filter((F.col("c") <= day) & (F.col("d") >= day)).count() <= total / 2
    assert ends.filter((F.col("c") <= day) & (F.col("d") >= day) & F.expr("a <= 10 and b >= 10")).count() <= total / 4


def test_exact_verification_compares_rows_only_where_fingerprints_differ(spark, root, name, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("p"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    tables.write_table(df, name, "create", root, partition_by=["p"])
    seen = []
    whole = tables.multiset_diff
    monkeypatch.setattr(tables, "multiset_diff", lambda a, b: (seen.append(a.count()), whole(a, b))[1])
    assert tables.verify_write(df, name, exact=True) == 60 and tables.verify_write(df, name, key=["id"]) == 60 and seen == []
    swapped = df.withColumn("id", F.when(F.col("id") == 4, F.lit(7)).otherwise(F.col("id")))
    with pytest.raises(RuntimeError, match="rows differ"):
        tables.verify_write(swapped, name, exact=True)
    assert seen == [20]
    assert rows(tables.differing_partitions(df, swapped, ["p"])) == [(1,)]


def test_convert_keeps_values(spark, root, name):
    df = spark.createDataFrame(
        [(1, "a,\"b\"", datetime(2024, 1, 2, 3, 4, 5, 678901), 0.1), (2, None, None, None)],
        "i int, s string, t timestamp, d double",
    )
    tables.write_table(df, name, "create", root)
    for fmt in ("json", "csv", "orc", "parquet"):
        tables.convert(spark, name, fmt)
        assert catalog.provider(spark, name) == fmt
        tables.verify_write(df, name, exact=True)


# --- key-wise writes ----------------------------------------------------------------------------


def test_append_absent_is_null_safe_and_collapses(spark, root, name):
    tables.write_table(kv(spark, (1, "a"), (None, "n")), name, "create", root)
    added = merge.append_absent(kv(spark, (1, "z"), (None, "z"), (2, "c"), (2, "b")), name, ["k"])
    assert added == 1 and rows(spark.table(name)) == [(None, "n"), (1, "a"), (2, "b")]


def test_appends_move_whole_rows_only_when_keys_are_absent(spark, root, name, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("not needed")

    tables.bootstrap_empty(spark, name, kv(spark, (1, "a")).schema, root)
    # an empty table: rows go straight into it
    with monkeypatch.context() as patch:
        patch.setattr(merge, "materialise", never)
        first = kv(spark, (1, "z"), (1, "a"), (None, "n"), (None, "m"), (2, None), (2, "b"))
        assert merge.append_absent(first, name, ["k"]) == 3
    assert rows(spark.table(name)) == [(None, "m"), (1, "a"), (2, None)]
    # more rows than Spark may send the keys of
    monkeypatch.setattr(merge, "FEW_ROWS", 0, raising=False)
    with monkeypatch.context() as patch:
        patch.setattr(merge, "one_per_key", never)
        assert merge.append_absent(first, name, ["k"]) == 0
    assert merge.append_absent(kv(spark, (None, "a"), (2, "a"), (3, "d"), (3, "c"), (4, None)), name, ["k"]) == 2
    assert rows(spark.table(name)) == [(None, "m"), (1, "a"), (2, None), (3, "c"), (4, None)]
    assert merge.append_absent(first.limit(0), name, ["k"]) == 0


@pytest.mark.parametrize("few", [0, 100])
def test_appends_by_two_keys_with_nulls(spark, root, name, monkeypatch, few):
    monkeypatch.setattr(merge, "FEW_ROWS", few, raising=False)
    kind = "a string, b double, v string"
    tables.write_table(spark.createDataFrame([("x", None, "1"), (None, 0.0, "2")], kind), name, "create", root)
    more = [("x", None, "0"), (None, -0.0, "0"), (None, None, "5"), (None, None, "4"), ("y", 1.0, "6"), ("x", 1.0, None)]
    assert merge.append_absent(spark.createDataFrame(more, kind), name, ["a", "b"]) == 3
    want = [(None, None, "4"), (None, 0.0, "2"), ("x", None, "1"), ("x", 1.0, None), ("y", 1.0, "6")]
    assert rows(spark.table(name)) == want


def test_one_per_key_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, None, "x")], "k int, t int, v string")
    want = [(1, 5, "a"), (2, None, "x")]
    assert rows(merge.one_per_key(df, ["k"], "t")) == want
    for kind in ("bigint", "date", "timestamp", "timestamp_ntz", "string", "double"):
        value = F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")) if "t" in kind and kind[0] in "dt" else F.col("t")
        kept = merge.one_per_key(df.withColumn("o", value.cast(kind)).drop("t"), ["k"], "o")
        assert rows(kept, "k", "v") == [(1, "a"), (2, "x")], kind
    assert rows(merge.one_per_key(df.select("k"), ["k"])) == [(1,), (2,)]


def test_export_rejects_null_ids(spark, root, name):
    with pytest.raises(Exception, match="NULL in id"):
        merge.keyed_export(kv(spark, (None, "a")), name, "k", root=root)
    assert not spark.catalog.tableExists(name)


def test_merge_duplicates_raise_before_anything_is_written(spark, root, name):
    tables.write_table(kv(spark, (1, "a")), name, "create", root)
    with pytest.raises(Exception, match="duplicate source key"):
        merge.merge_into(kv(spark, (1, "x"), (1, "y")), name, ["k"])
    assert rows(spark.table(name)) == [(1, "a")] and len(tables.versions(spark, name)) == 1


def test_merge_of_touched_partitions_leaves_the_others_alone(spark, root, name):
    tables.write_table(kv(spark, (1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")), name, "create", root, partition_by=["v"])
    files = lambda: {r.f for r in spark.table(name).filter("v = 'c'").select(F.input_file_name().alias("f")).collect()}
    before = files()
    source = spark.createDataFrame([(1, "a", True), (3, "b", False), (9, None, False), (8, "new", False)], "k int, v string, gone boolean")
    merge.merge_into(source, name, ["k", "v"], "gone", touched_only=True)
    assert rows(spark.table(name)) == [(2, "a"), (3, "b"), (4, None), (5, "c"), (8, "new"), (9, None)]
    assert files() == before and len(tables.versions(spark, name)) == 1
    # a partition that loses all its rows
    merge.merge_into(spark.createDataFrame([(5, "c", True)], "k int, v string, gone boolean"), name, ["k", "v"], "gone", touched_only=True)
    assert rows(spark.table(name)) == [(2, "a"), (3, "b"), (4, None), (8, "new"), (9, None)]
    with pytest.raises(ValueError):
        merge.merge_into(kv(spark, (1, "a")), name, ["k"], touched_only=True)


keys = st.one_of(st.none(), st.integers(0, 6))


@settings(max_examples=8, deadline=None)
@given(
    target=st.lists(st.tuples(keys, st.sampled_from("abc")), max_size=8),
    source=st.dictionaries(keys, st.tuples(st.one_of(st.none(), st.sampled_from("xyz")), st.booleans()), max_size=6),
)
def test_merge_agrees_with_a_dict(spark, target, source):
    t = spark.createDataFrame(target, KV)
    s = spark.createDataFrame([(k, v, d) for k, (v, d) in source.items()], "k int, v string, gone boolean")
    got = rows(merge.merge_by_key(t, s, ["k"], "gone"))
    want = [(k, source[k][0] if k in source else v) for k, v in target if not (k in source and source[k][1])]
    want += [(k, v) for k, (v, d) in source.items() if not d and k not in {x for x, _ in target}]
    assert got == sorted(want, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


# --- descriptors --------------------------------------------------------------------------------


def describe(spark, fields, parts=(), fmt="parquet", location="/x", table="t"):
    schema = StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in fields))
    return descriptors.describe_schema(spark, {table: schema}, {table: parts}, {table: fmt}, {table: location})


BASE = [("a", "int"), ("b", "string")]


@pytest.mark.parametrize(
    "fields, parts, fmt, action, reason",
    [
        (BASE, (), "PARQUET", "reuse", None),
        (BASE, (), "orc", "recreate", "format"),
        ([("a", "int"), ("c", "string")], (), "parquet", "recreate", "column 1 name"),
        ([("a", "bigint"), ("b", "string")], (), "parquet", "recreate", "column 0 type"),
        ([("b", "string"), ("a", "int")], (), "parquet", "recreate", "column 0 name"),
        (BASE + [("c", "int")], (), "parquet", "recreate", "column 2 added"),
        (BASE[:1], (), "parquet", "recreate", "column 1 removed"),
        (BASE, ("b",), "parquet", "recreate", "partitions"),
    ],
)
def test_plan_change(spark, fields, parts, fmt, action, reason):
    out = descriptors.plan_change(describe(spark, BASE), describe(spark, fields, parts, fmt))
    assert rows(out) == [("t", action, reason)]


def test_plan_change_arity_sees_counts_only(spark):
    renamed = describe(spark, [("a", "int"), ("c", "string")])
    assert rows(descriptors.plan_change(describe(spark, BASE), renamed, "arity")) == [("t", "reuse", None)]
    more = describe(spark, BASE + [("c", "int")])
    assert rows(descriptors.plan_change(describe(spark, BASE), more, "arity")) == [("t", "recreate", "column count")]


def test_plan_change_one_sided(spark):
    out = descriptors.plan_change(describe(spark, BASE, table="old"), describe(spark, BASE, table="new"))
    assert rows(out) == [("new", "create", "missing"), ("old", "ignore", "not requested")]


def test_partition_order_counts(spark):
    left, right = describe(spark, BASE, ("a", "b")), describe(spark, BASE, ("b", "a"))
    assert rows(descriptors.plan_change(left, right)) == [("t", "recreate", "partitions")]
    assert rows(descriptors.registry_diff(left, right)) == [("t", False, False, True, None)]
    assert rows(descriptors.partition_columns(right)) == [("t", ["b", "a"])]
    assert rows(descriptors.partition_columns(describe(spark, BASE))) == [("t", [])]


def test_registry_diff(spark):
    left = describe(spark, BASE, location="/new")
    assert rows(descriptors.registry_diff(left, describe(spark, BASE, location="/old"))) == [("t", True, False, False, None)]
    retyped = describe(spark, [("a", "int"), ("b", "int")], location="/new")
    assert rows(descriptors.registry_diff(left, retyped)) == [("t", False, True, False, None)]
    other = describe(spark, BASE, table="u")
    assert rows(descriptors.registry_diff(left, other)) == [("t", False, False, False, "right"), ("u", False, False, False, "left")]


def test_descriptor_keeps_nested_case(spark):
    schema = StructType().add("s", StructType().add("CamelCase", IntegerType()))
    row = descriptors.describe_schema(spark, {"t": schema}).first()
    assert "CamelCase" in row.type_json and row.type_name == "STRUCT"


def test_valid_names(spark):
    df = spark.createDataFrame([("ok_1-2",), ("delta.s3://x",), ("",), (None,), ("a b",), ("a\n",)], "n string")
    assert [r.ok for r in descriptors.valid_names(df, "n").collect()] == [True, False, False, False, False, False]


def test_orphans(spark):
    files = spark.createDataFrame([("file:/lake/a/1", 5), ("file:/lake/a/2", 6), ("file:/lake/b/1", 7)], "path string, length bigint")
    entries = spark.createDataFrame([("b", "file:///lake/b/"), ("c", "file:/lake/c")], "table_name string, location string")
    assert rows(descriptors.orphans(files, entries)) == [
        ("no data", "file:/lake/c", "c", 0, 0), ("no entry", "file:/lake/a", None, 2, 11),
    ]


def test_an_append_during_a_rewrite_is_not_lost(spark, root, name, monkeypatch):
    table = spark.range(10).select(F.col("id").cast("int").alias("id"))
    tables.write_table(table, name, "create", root, properties={"lakekit.batch": "7"})
    save = tables._save

    def slow_save(*args, **kwargs):
        monkeypatch.setattr(tables, "_save", save)
        tables.append(spark.range(100, 105).select(F.col("id").cast("int").alias("id")), name)
        return save(*args, **kwargs)

    monkeypatch.setattr(tables, "_save", slow_save)
    with pytest.raises(tables.Conflict):
        tables.compact(spark, name)
    assert spark.table(name).count() == 15
    tables.compact(spark, name)
    assert spark.table(name).count() == 15
    assert view_properties(spark, name)["lakekit.batch"] == "7"


def test_unknown_columns_are_an_error(spark, root, name):
    tables.write_table(spark.range(3), name, "create", root)
    more = spark.range(3).withColumn("extra", F.lit(1))
    for write in (lambda: tables.append(more, name), lambda: merge.append_absent(more, name, ["id"]), lambda: merge.merge_into(more, name, ["id"])):
        with pytest.raises(ValueError, match="extra"):
            write()


def test_maps_in_keyed_writes(spark, root, name):
    kind = "ts int, labels map<string,string>, value double"
    first = spark.createDataFrame([(1, {"a": "x", "b": "y"}, 1.0), (1, {"b": "y", "a": "x"}, 2.0)], kind)
    assert len(merge.one_per_key(first, ["ts", "labels"]).collect()) == 1
    tables.write_table(merge.one_per_key(first, ["ts"]), name, "create", root)
    assert merge.append_absent(spark.createDataFrame([(1, {}, 0.0), (2, {"c": "z"}, 3.0)], kind), name, ["ts"]) == 1
    assert tables.multiset_diff(spark.table(name), spark.table(name)).count() == 0


def test_a_small_merge_does_not_move_the_target(spark, root, name):
    tables.write_table(spark.range(1000).withColumn("v", F.lit("old")), name, "create", root)
    # stored, as merge_into does it, so that Spark knows the size
    source = materialise(spark.createDataFrame([(1, "new"), (5000, "new")], "id bigint, v string"), f"{root}/source")
    merged = merge.merge_by_key(tables.current(spark, name), source, ["id"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # the target meets the broadcast source twice: for the update and to find which keys are there
    assert merged.count() == 1001
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert "SortMergeJoin" not in plan.split("LeftOuter")[0]
