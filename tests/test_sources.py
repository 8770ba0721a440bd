import os
import subprocess
import sys

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lakekit.operators import metrics, tables
from lakekit.sources import catalog, event_logs, files


def local(root):
    path = root.removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def touch(path, content=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def test_read_path(spark):
    assert files.read_path(spark, f"{SF}/nation.parquet").count() == 25
    narrow = StructType().add("n_regionkey", "integer")
    assert files.read_path(spark, f"{SF}/nation.parquet", schema=narrow).columns == ["n_regionkey"]


def test_listing_reads_no_content(spark, root):
    base = local(root)
    touch(f"{base}/cycle=2022/form_family=A/x.bin", b"12345")
    touch(f"{base}/cycle=2022/_months/2022-01.done", b"x")
    touch(f"{base}/cycle=2022/_months/2022-02.done")
    listed = files.with_path_keys(files.list_files(spark, base, "*.bin"), {"cycle": "int", "form_family": "string", "none": "int"})
    assert rows(listed, "name", "length", "cycle", "form_family", "none") == [("x.bin", 5, 2022, "A", None)]
    assert files.list_files(spark, base).count() == 1  # hidden folders only when named
    marks = files.list_files(spark, f"{base}/cycle=*/_months")
    assert rows(marks, "name") == [("2022-01.done",)]  # Spark passes over the empty one
    markers = files.list_markers(spark, f"{base}/cycle=*/_months/*")
    assert rows(markers, "name", "length") == [("2022-01.done", 1), ("2022-02.done", 0)]
    assert files.list_markers(spark, f"{base}/nowhere/*").count() == 0
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_row_counts(spark, root):
    base = local(root)
    spark.range(7).write.partitionBy().parquet(f"{base}/s/full")
    spark.range(6).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{base}/s/parts")
    spark.range(0).write.parquet(f"{base}/s/empty")
    touch(f"{base}/s/full/_delta_log/00.checkpoint.parquet", b"not counted")
    assert rows(files.row_counts(spark, base), "table_name", "row_count", "corrupt_skipped") == [
        ("empty", 0, False), ("full", 7, False), ("parts", 6, False),
    ]
    touch(f"{base}/s/full/broken.parquet", b"garbage, not a footer")
    with pytest.raises(Exception):
        files.row_counts(spark, base).collect()
    skipped = {r.table_name: (r.row_count, r.corrupt_skipped) for r in files.row_counts(spark, base, skip_corrupt=True).collect()}
    assert skipped["full"] == (7, True) and skipped["parts"] == (6, False)


def test_row_counts_need_nothing_but_footers(spark, root):
    base = local(root)
    spark.range(50).coalesce(1).write.parquet(f"{base}/s/t")
    before = {k: spark.conf.get(k, None) for k in files.FOOTER_COUNTS}
    assert {k: spark.conf.get(k, None) for k in files.FOOTER_COUNTS} == before
    # only the footer is left of the file: its pages are overwritten, and the count is still right
    part = next(f for f in os.listdir(f"{base}/s/t") if f.endswith(".parquet"))
    with open(f"{base}/s/t/{part}", "r+b") as data:
        data.seek(4)
        data.write(b"\0" * 64)
    crc = f"{base}/s/t/.{part}.crc"
    os.path.exists(crc) and os.remove(crc)
    assert files.row_counts(spark, base).first()["row_count"] == 50
    assert rows(files.row_counts(spark, base, skip_corrupt=True), "row_count", "corrupt_skipped") == [(50, False)]


def test_typed_rows(spark):
    df = files.rows(spark, [("a", 1.5, 2)], "id string, score float, count int")
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "float", "int"]


def test_names_and_collisions(spark, root, name):
    assert catalog.qualify("shop", "silver", "t-1") == ("shop", "silver.t-1")
    for bad in ("a.b", "a/b", "a b", ""):
        with pytest.raises(ValueError):
            catalog.qualify("shop", "silver", bad)
    tables.write_table(spark.range(2), name, "create", root)
    schema, table = name.split(".")
    union = catalog.read_many(spark, [("shop", schema, table)])
    assert rows(union) == [(0, "shop", schema, table), (1, "shop", schema, table)]
    with pytest.raises(ValueError, match="claimed"):
        catalog.read_many(spark, [("shop", schema, table), ("other", schema, table)])


def test_catalog_listing(spark, root, name):
    tables.write_table(spark.range(2), name, "create", root)
    listed = catalog.catalog_tables(spark, ["default", "nowhere"])
    mine = [r for r in listed.collect() if r.table_name.startswith(name.split(".")[1])]
    assert len(mine) == 1 and mine[0].schema_name == "default"
    with pytest.raises(ValueError, match="no provider|provider"):
        spark.range(1).createOrReplaceTempView("just_a_view")
        catalog.read_registered(spark, "just_a_view")


def test_schema_properties(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS readiness_props WITH DBPROPERTIES ('pipeline.last_run_at' = '2024-01-01T00:00:00Z', 'team' = 'x')")
    try:
        found = {r.name: r.properties for r in catalog.schema_properties(spark, ["readiness_props"]).collect()}
        assert found == {"readiness_props": {"pipeline.last_run_at": "2024-01-01T00:00:00Z", "team": "x"}}
    finally:
        spark.sql("DROP DATABASE readiness_props")


LOGGED_JOB = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1])
    .config("spark.sql.shuffle.partitions", "3").config("spark.task.maxFailures", "1").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
spark.range(1000).groupBy(F.col("id") % 7).count().collect()
try:
    spark.range(4).select(F.raise_error(F.lit("no"))).collect()
except Exception:
    pass
spark.stop()
"""


def test_event_logs(spark, root):
    base = local(root)
    subprocess.run([sys.executable, "-c", LOGGED_JOB, base], check=True, capture_output=True, timeout=180)
    events = event_logs.read_event_logs(spark, base)
    summary = metrics.job_summary(event_logs.jobs(events)).first()
    assert summary.jobs >= 2 and summary.failed_jobs == 1 and summary.active_jobs == 0
    stages = event_logs.stages(events)
    assert stages.filter(F.col("failure").isNotNull()).count() == 1
    tasks = event_logs.tasks(events)
    per_stage = metrics.stage_summary(tasks)
    assert per_stage.agg(F.sum("tasks")).first()[0] == tasks.count()
    assert per_stage.agg(F.sum("failed_tasks")).first()[0] >= 1
    assert per_stage.agg(F.sum("shuffle_write_bytes")).first()[0] > 0
    ran = event_logs.sql_executions(events)
    assert ran.count() >= 2 and ran.filter(F.col("ended_at").isNull()).count() == 0
