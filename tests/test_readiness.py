from datetime import datetime, timezone
from threading import Barrier

from conftest import rows
from pyspark.sql import functions as F

from lakekit.operators import tables
from lakekit.plans import readiness, reports

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
STAMP = datetime(2024, 2, 1)


def test_pipeline_status(spark):
    k = readiness.RUN_PROPERTY
    props = spark.createDataFrame(
        [
            ("good", {k + "status": "success", k + "at": "2024-01-31T10:00:00Z", k + "duration_sec": "12", k + "table_count": "0"}),
            ("bad", {k + "at": "soon", k + "duration_sec": "x"}),
            ("empty", {k + "duration_sec": "", k + "version": "v1"}),
            ("none", {}),
        ],
        "name string, properties map<string,string>",
    )
    out = readiness.pipeline_status(props, NOW, "lake")
    got = rows(out, "schema_name", "last_run_status", "last_run_at", "last_run_duration_sec", "last_run_table_count", "last_run_version", "parse_error")
    assert got == [
        ("bad", None, None, None, None, None, True),
        ("empty", None, None, None, None, "v1", False),
        ("good", "success", datetime(2024, 1, 31, 10), 12, 0, None, False),
        ("none", None, None, None, None, None, False),
    ]
    assert out.select("collected_at").distinct().collect()[0][0] == STAMP


def test_inventory_and_counts(spark):
    found = spark.createDataFrame([("silver", "pay_2024"), ("silver", "plain"), ("gold", "pay_2022")], "schema_name string, table_name string")
    inventory = readiness.table_inventory(found, NOW, "lake")
    assert rows(inventory, "table_name", "cycle", "form_family") == [
        ("pay_2022", 2022, "pay"), ("pay_2024", 2024, "pay"), ("plain", None, None),
    ]
    counts = spark.createDataFrame(
        [("silver", "pay_2024", 5), ("silver", "plain", 0), ("gold", "pay_2022", None), ("gold", "unknown", 3)],
        "schema_name string, table_name string, row_count bigint",
    )
    snapshot = readiness.row_count_snapshot(inventory, counts, NOW)
    assert rows(snapshot, "table_name", "row_count") == [("pay_2024", 5), ("plain", 0)]


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_sentinels(spark):
    files = paths(
        spark, "b/partitioned/cycle=2022/_months/2022-01.done", "b/partitioned/cycle=2022/_months/2022-02.tmp",
        "b/other/_months/2022-01.done", "b/partitioned/cycle=2022/2022-03.done",
    )
    assert rows(readiness.sentinels(files, NOW)) == [(STAMP, 2022, "2022-01", "b/partitioned/cycle=2022/_months/2022-01.done")]


def test_schema_drift(spark):
    files = paths(
        spark, "p/cycle=2022/form_family=A/x", "p/cycle=2022/form_family=A/y", "p/cycle=2024/form_family=B/x",
        "p/form_family=C/x", "p/cycle=2024/_months/2024-01.done",
    )
    registry = spark.createDataFrame([("A",), ("A",), ("Z",)], "form_family string")
    assert rows(readiness.schema_drift(files, registry, NOW), "form_family", "cycle", "has_data", "in_registry") == [
        ("A", 2022, True, True), ("B", 2024, True, False),
    ]
    assert {r.in_registry for r in readiness.schema_drift(files, None, NOW).collect()} == {False}


def test_freshness(spark):
    commits = spark.createDataFrame(
        [
            ("lake/a/_delta_log/0.json", datetime(2024, 1, 31)),
            ("lake/a/_delta_log/1.json", datetime(2024, 1, 31, 12, 20)),
            ("lake/b/_delta_log/0.json", datetime(2024, 2, 1, 3)),
            ("lake/c/part-0.parquet", datetime(2024, 1, 1)),
        ],
        "path string, modified_at timestamp",
    )
    assert rows(readiness.freshness(commits, NOW), "table_name", "path", "age_hours") == [
        ("a", "lake/a/", 11.67), ("b", "lake/b/", -3.0),
    ]


def test_run_readiness_reports_failures_and_repeats_add_nothing(spark, root, name):
    files = paths(spark, "p/cycle=2022/_months/2022-01.done", "p/cycle=2022/_months/2022-02.done")
    marks = readiness.sentinels(files, NOW)
    tables.create_table(spark, name, marks.schema, root)

    def broken():
        raise RuntimeError("storage is away")

    collectors = {"freshness": broken, "sentinels": lambda: marks}
    targets = {"sentinels": name, "freshness": "default.nothing"}
    report = rows(readiness.run_readiness(spark, collectors, targets))
    assert report == [("freshness", None, "failed", "storage is away"), ("sentinels", 2, "ok", None)]
    again = rows(readiness.run_readiness(spark, {"sentinels": lambda: marks}, targets))
    assert again == [("sentinels", 0, "ok", None)]
    assert spark.table(name).count() == 2


def test_collectors_of_different_tables_run_side_by_side(spark, root, name):
    files = paths(spark, "p/cycle=2022/_months/2022-01.done")
    marks = readiness.sentinels(files, NOW)
    tables.create_table(spark, name, marks.schema, root)
    both = Barrier(2, timeout=60)

    def meets():
        both.wait()
        return marks

    def fails():
        both.wait()
        raise RuntimeError("storage is away")

    targets = {"sentinels": name, "freshness": "default.nothing"}
    report = rows(readiness.run_readiness(spark, {"sentinels": meets, "freshness": fails}, targets))
    assert report == [("freshness", None, "failed", "storage is away"), ("sentinels", 1, "ok", None)]
    # one after the other when only one may run: the barrier breaks for both
    alone = Barrier(2, timeout=0.2)
    report = rows(readiness.run_readiness(spark, {"sentinels": alone.wait, "freshness": alone.wait}, targets, at_once=1))
    assert [r[2] for r in report] == ["failed", "failed"]
    assert rows(readiness.run_readiness(spark, {}, {})) == []


def test_latest_snapshot(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "collected_at int, v string")
    assert rows(reports.latest_snapshot(df), "v") == [("b",), ("c",)]
    assert reports.latest_snapshot(df.filter("false")).count() == 0
    assert reports.latest_snapshot(df.filter("collected_at is null")).count() == 0


def test_param_filter(spark):
    df = spark.createDataFrame([(2022, "x"), (2024, "y"), (None, "z")], "cycle int, s string")
    assert rows(reports.param_filter(df, {"cycle": "2022"}), "s") == [("x",)]
    assert reports.param_filter(df, {"cycle": ["2022", "All"]}).count() == 3
    assert reports.param_filter(df, {"cycle": []}).count() == 0
    assert reports.param_filter(df, {"cycle": "abc"}).count() == 0
    assert reports.param_filter(df, {"s": ["x", "y"], "cycle": ["2024"]}).count() == 1


def test_inventory_matrix_shows_missing_cycle(spark):
    tables_ = spark.createDataFrame([("s", "a_2022"), ("s", "b_2022"), ("s", "c"), ("t", "d_2024")], "schema_name string, table_name string")
    inventory = readiness.table_inventory(tables_, NOW, "lake")
    assert [tuple(r) for r in reports.inventory_matrix(inventory, "lake").collect()] == [("s", "2022", 2), ("s", "N/A", 1), ("t", "2024", 1)]
    assert reports.inventory_matrix(inventory, "elsewhere").count() == 0
    assert [tuple(r) for r in reports.inventory_matrix(inventory, "lake", "2022").collect()] == [("s", "2022", 2)]


def test_row_count_series_labels(spark):
    df = spark.createDataFrame(
        [(STAMP, "lake", "s", 2022, 5), (STAMP, "lake", "s", 2022, 6), (STAMP, "lake", "s", None, 7), (datetime(2020, 1, 1), "lake", "s", 1, 1)],
        "collected_at timestamp, catalog string, schema_name string, cycle int, row_count bigint",
    )
    out = reports.row_count_series(df, "lake", end=datetime(2024, 2, 2, tzinfo=timezone.utc))
    assert rows(out) == [(STAMP, "s", 7), (STAMP, "s / 2022", 11)]


def test_reduce_series(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    assert rows(reports.reduce_series(df, "k", "t", "v")) == [("a", 3.0, 5.0, 2), ("b", None, None, 0)]


def test_preview(spark):
    df = spark.range(10)
    shown, truncated = reports.preview(df, 4)
    assert truncated and [r.id for r in shown.collect()] == [0, 1, 2, 3]
    assert reports.preview(df, 10)[1] is False


def test_run_sql_does_not_paste(spark):
    spark.range(3).createOrReplaceTempView("preview_numbers")
    out = reports.run_sql(spark, "SELECT count(*) n FROM preview_numbers WHERE cast(id AS string) = :v", {"v": "1 OR true"})
    assert out.first().n == 0


def test_report_panels(spark):
    from lakekit.bindings.reporting import readiness_report

    assert {r.panel for r in readiness_report(spark, "/root/testdata/sf0.001").collect()} >= {"inventory", "drift", "freshness"}


def test_choices(spark):
    df = spark.createDataFrame([(2,), (1,), (None,), (2,)], "c int")
    assert [r.c for r in reports.choices(df, "c", desc=True).collect()] == [2, 1]
    assert reports.time_filter(df.select(F.lit(STAMP).alias("t")), "t", STAMP, STAMP).count() == 4
