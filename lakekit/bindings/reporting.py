"""Readiness collectors and reports on snapshots derived from the test tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.bands import band, map_values, map_values_table
from ..functions.text import (
    file_name,
    in_csv,
    json_string,
    map_get,
    map_with_prefix,
    path_key,
    strip_suffix,
)
from ..operators import tables
from ..plans import readiness, reports
from ..sources.files import with_path_keys
from .common import NOW, NOW_SQL, fresh_table, table, zoneless


def _run_properties(spark, folder):
    """One schema per event with run properties, some of them malformed."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    key = lambda name: F.lit(readiness.RUN_PROPERTY + name)
    return e.select(
        F.concat(F.lit("schema_"), F.col("event_id")).alias("name"),
        F.create_map(
            key("status"),
            F.when(kind == "purchase", "success").when(kind == "error", "failed").otherwise("running"),
            key("at"),
            F.when(kind == "error", "not a time").otherwise(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            ),
            key("duration_sec"),
            F.when(kind == "view", "n/a").when(kind == "signup", "").otherwise(k),
            key("table_count"),
            F.when(kind != "click", k),
            key("execution_id"),
            F.concat(F.lit("run-"), F.col("user_id")),
        ).alias("properties"),
        F.date_trunc("day", "ts").alias("day"),
        "event_type",
    )


_RUN_COLUMNS = """
    'schema_' || event_id AS schema_name,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS last_run_status,
    CASE WHEN event_type <> 'error' THEN ts END AS last_run_at,
    CASE WHEN event_type NOT IN ('view', 'signup') THEN CAST(props->>'$.k' AS INTEGER) END AS last_run_duration_sec,
    CASE WHEN event_type <> 'click' THEN CAST(props->>'$.k' AS INTEGER) END AS last_run_table_count,
    'run-' || user_id AS last_run_execution_id,
    CAST(NULL AS VARCHAR) AS last_run_version"""


def latest_snapshot(spark, folder):
    e = table(spark, folder, "events").withColumn("collected_at", F.date_trunc("day", "ts"))
    return zoneless(reports.latest_snapshot(e))


def run_status(spark, folder):
    return zoneless(readiness.pipeline_status(_run_properties(spark, folder), NOW, "lake"))


def last_runs(spark, folder):
    snapshots = readiness.pipeline_status(_run_properties(spark, folder), F.col("day"), F.col("event_type"))
    return zoneless(reports.last_runs(snapshots, "purchase"))


def _tables(spark, folder):
    """One registered table per order: cycle-suffixed names, and names without suffix."""
    o = table(spark, folder, "orders")
    suffixed = F.concat_ws("_", F.lower("o_orderstatus"), F.col("o_orderkey"), F.year("o_orderdate"))
    plain = F.concat(F.lit("extra_"), F.col("o_orderkey"), F.lit("_x"))
    return o.select(
        F.lower("o_orderpriority").alias("schema_name"),
        F.when(F.col("o_orderstatus") == "P", plain).otherwise(suffixed).alias("table_name"),
    )


_TABLES_SQL = """
    SELECT lower(o_orderpriority) AS schema_name,
           CASE WHEN o_orderstatus = 'P' THEN 'extra_' || o_orderkey || '_x'
                ELSE lower(o_orderstatus) || '_' || o_orderkey || '_' || year(o_orderdate) END AS table_name
    FROM orders"""
_INVENTORY_SQL = f"""
    SELECT schema_name, table_name,
           CAST(nullif(regexp_extract(table_name, '^(.+)_([0-9]{{4}})$', 2), '') AS INTEGER) AS cycle,
           nullif(regexp_extract(table_name, '^(.+)_([0-9]{{4}})$', 1), '') AS form_family
    FROM ({_TABLES_SQL})"""


def table_inventory(spark, folder):
    return zoneless(readiness.table_inventory(_tables(spark, folder), NOW, "lake"))


def inventory_matrix(spark, folder):
    inventory = readiness.table_inventory(_tables(spark, folder), NOW, "lake")
    return reports.inventory_matrix(inventory, "lake")


def inventory_matrix_filtered(spark, folder):
    inventory = readiness.table_inventory(_tables(spark, folder), NOW, "lake")
    matrix = reports.inventory_matrix(inventory, "lake", "1998", ["1-urgent", "5-low"])
    return matrix.withColumn("colour", band(F.col("table_count"), reports.TABLE_COUNT_STEPS))


def choices(spark, folder):
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("cycle"))
    return reports.choices(o, "cycle", desc=True)


def param_filter(spark, folder):
    o = table(spark, folder, "orders").withColumn("cycle", F.year("o_orderdate"))
    return reports.param_filter(o, {"cycle": "1999", "o_orderstatus": ["F", "O"], "o_orderpriority": "All"})


def time_filter(spark, folder):
    return reports.time_filter(table(spark, folder, "events"), "ts", datetime(2024, 1, 10), datetime(2024, 1, 17))


def row_count_snapshot(spark, folder):
    name = F.concat_ws("_", F.lit("ship"), F.year("l_shipdate"))
    counts = (
        table(spark, folder, "lineitem")
        .groupBy(F.lower("l_returnflag").alias("schema_name"), name.alias("table_name"))
        .agg(F.count("*").alias("row_count"))
    )
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    tables = years.select(
        F.explode(F.array(F.lit("a"), F.lit("r"), F.lit("unknown"))).alias("schema_name"),
        F.concat_ws("_", F.lit("ship"), F.col("y")).alias("table_name"),
    )
    inventory = readiness.table_inventory(tables, NOW, "lake")
    return zoneless(readiness.row_count_snapshot(inventory, counts, NOW))


def _row_counts(spark, folder):
    """Snapshots by ship month; line status F has no cycle."""
    return table(spark, folder, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("timestamp").alias("collected_at"),
        F.lit("lake").alias("catalog"),
        F.lower("l_returnflag").alias("schema_name"),
        F.when(F.col("l_linestatus") == "O", F.year("l_shipdate")).alias("cycle"),
        F.col("l_quantity").cast("bigint").alias("row_count"),
    )


def row_count_series(spark, folder):
    start, end = datetime(1997, 1, 1, tzinfo=timezone.utc), datetime(1999, 12, 1, tzinfo=timezone.utc)
    return zoneless(reports.row_count_series(_row_counts(spark, folder), "lake", "All", ["a", "r"], start, end))


def _marker_files(spark, folder):
    o = table(spark, folder, "orders")
    ending = F.when(F.col("o_orderstatus") == "P", ".tmp").otherwise(".done")
    month = F.date_format("o_orderdate", "yyyy-MM")
    return o.select(
        F.concat(
            F.lit("partitioned/cycle="), F.year("o_orderdate"), F.lit("/_months/"), month,
            F.lit("."), F.col("o_orderkey"), ending,
        ).alias("path")
    )


_MARKERS_SQL = f"""
    SELECT {NOW_SQL} AS collected_at, CAST(year(o_orderdate) AS INTEGER) AS cycle,
           strftime(o_orderdate, '%Y-%m') || '.' || o_orderkey AS month,
           'partitioned/cycle=' || year(o_orderdate) || '/_months/' || strftime(o_orderdate, '%Y-%m')
               || '.' || o_orderkey || '.done' AS sentinel_key
    FROM orders WHERE o_orderstatus <> 'P'"""


def sentinels(spark, folder):
    return zoneless(readiness.sentinels(_marker_files(spark, folder), NOW))


def sentinel_coverage(spark, folder):
    covered = reports.sentinel_coverage(readiness.sentinels(_marker_files(spark, folder), NOW))
    return covered.withColumn("colour", band(F.col("sentinel_count"), reports.SENTINEL_COUNT_STEPS))


def _family_files(spark, folder):
    p = table(spark, folder, "part")
    family = F.translate("p_name", " ", "_")
    cycle = F.lit(2000) + F.col("p_size")
    return p.select(
        F.concat(
            F.lit("partitioned/cycle="), cycle, F.lit("/form_family="), family, F.lit("/part-"), F.col("p_partkey")
        ).alias("path")
    )


def _registry(spark, folder):
    large = table(spark, folder, "part").filter((F.col("p_type") == "LARGE") & (F.col("p_size") > 40))
    return large.select(F.translate("p_name", " ", "_").alias("form_family"))


_DRIFT_SQL = f"""
    SELECT DISTINCT {NOW_SQL} AS collected_at, replace(p_name, ' ', '_') AS form_family,
           CAST(2000 + p_size AS INTEGER) AS cycle, TRUE AS has_data,
           p_name IN (SELECT p_name FROM part WHERE p_type = 'LARGE' AND p_size > 40) AS in_registry
    FROM part"""


def schema_drift(spark, folder):
    return zoneless(readiness.schema_drift(_family_files(spark, folder), _registry(spark, folder), NOW))


def drift_list(spark, folder):
    drift = readiness.schema_drift(_family_files(spark, folder), _registry(spark, folder), NOW)
    listed = reports.drift_list(drift, "2010")
    return listed.withColumn("label", map_values(F.col("in_registry").cast("string"), reports.DRIFT_LABELS))


def _commits(spark, folder):
    e = table(spark, folder, "events")
    name = F.concat_ws("_", F.col("event_type"), F.col("user_id"))
    return e.select(
        F.concat(F.lit("lake/"), name, F.lit("/_delta_log/"), F.col("event_id"), F.lit(".json")).alias("path"),
        F.col("ts").alias("modified_at"),
    )


def freshness(spark, folder):
    return zoneless(readiness.freshness(_commits(spark, folder), NOW))


def freshness_bands(spark, folder):
    listed = reports.freshness_list(readiness.freshness(_commits(spark, folder), NOW))
    return listed.withColumn("colour", band(F.col("age_hours"), reports.FRESHNESS_STEPS))


_FRESHNESS_SQL = f"""
    SELECT {NOW_SQL} AS collected_at, event_type || '_' || user_id AS table_name,
           'lake/' || event_type || '_' || user_id || '/' AS path, max(ts) AS last_modified_at,
           round((epoch_us({NOW_SQL}) - epoch_us(max(ts))) / 3.6e9, 2) AS age_hours
    FROM events GROUP BY event_type, user_id"""

_STATUS = {"F": "finished", "O": "open"}


def value_mapping(spark, folder):
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", map_values(F.col("o_orderstatus"), _STATUS, "other").alias("label"))


def value_mapping_table(spark, folder):
    mapping = table(spark, folder, "nation").select("n_nationkey", "n_name")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return map_values_table(c, "c_nationkey", mapping, "nation", "unknown")


def series_reduce(spark, folder):
    e = table(spark, folder, "events")
    noisy = e.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return reports.reduce_series(noisy, "user_id", "ts", "value")


def preview(spark, folder):
    shown, truncated = reports.preview(table(spark, folder, "orders"), 1000, ["o_orderkey"])
    return shown.withColumn("truncated", F.lit(truncated))


def run_sql(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("lakekit_orders")
    text = """
        SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM lakekit_orders
        WHERE o_totalprice >= :least AND array_contains(:statuses, o_orderstatus)
        GROUP BY o_orderpriority"""
    return reports.run_sql(spark, text, {"least": 100000.0, "statuses": F.array(F.lit("F"), F.lit("P"))})


def readiness_report(spark, folder):
    snapshots = {
        "run_status": readiness.pipeline_status(_run_properties(spark, folder), F.col("day"), "lake"),
        "table_inventory": readiness.table_inventory(_tables(spark, folder), NOW, "lake"),
        "row_counts": _row_counts(spark, folder),
        "sentinels": readiness.sentinels(_marker_files(spark, folder), NOW),
        "schema_drift": readiness.schema_drift(_family_files(spark, folder), _registry(spark, folder), NOW),
        "freshness": readiness.freshness(_commits(spark, folder), NOW),
    }
    start, end = datetime(1995, 1, 1, tzinfo=timezone.utc), datetime(2002, 12, 1, tzinfo=timezone.utc)
    panels = reports.readiness_report(snapshots, {"domain": "lake", "start": start, "end": end})
    out = None
    for name, panel in panels.items():
        counted = panel.agg(F.count("*").alias("rows")).select(F.lit(name).alias("panel"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


def _readiness(spark, folder):
    """The six collectors over the given tables, and snapshot tables for them, partitioned by run."""
    inventory = readiness.table_inventory(_tables(spark, folder), NOW, "lake")
    # an order stands for a table, its lines for the rows
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("row_count"))
    named = _tables(spark, folder).withColumn("l_orderkey", F.regexp_extract("table_name", r"_(\d+)_", 1).cast("bigint"))
    counts = named.join(lines, "l_orderkey").select("schema_name", "table_name", "row_count")
    collectors = {
        "run_status": lambda: readiness.pipeline_status(_run_properties(spark, folder), NOW, "lake"),
        "table_inventory": lambda: inventory,
        "row_counts": lambda: readiness.row_count_snapshot(inventory, counts, NOW),
        "sentinels": lambda: readiness.sentinels(_marker_files(spark, folder), NOW),
        "schema_drift": lambda: readiness.schema_drift(_family_files(spark, folder), _registry(spark, folder), NOW),
        "freshness": lambda: readiness.freshness(_commits(spark, folder), NOW),
    }
    targets = {}
    for name, collect in collectors.items():
        targets[name], root = fresh_table(spark, f"snapshot_{name}")
        tables.create_table(spark, targets[name], collect().schema, root, partition_by=["collected_at"])
    return collectors, targets


def run_readiness(spark, folder):
    """All six collectors into their snapshot tables, twice; the second run adds nothing."""
    collectors, targets = _readiness(spark, folder)
    first = readiness.run_readiness(spark, collectors, targets).withColumn("run", F.lit(1))
    second = readiness.run_readiness(spark, collectors, targets).withColumn("run", F.lit(2))
    return first.unionByName(second)


def readiness_snapshots(spark, folder):
    """What a run leaves in the snapshot tables of inventory and row counts."""
    collectors, targets = _readiness(spark, folder)
    wanted = ["table_inventory", "row_counts"]
    readiness.run_readiness(spark, {n: collectors[n] for n in wanted}, targets)
    inventory, counts = (spark.table(targets[n]) for n in wanted)
    columns = ["collected_at", "catalog", "schema_name", "table_name", "cycle"]
    both = inventory.select(*columns, "form_family").join(counts.select(*columns, "row_count"), columns[:-1], "left")
    return zoneless(both.select(*columns[:-1], inventory["cycle"], "form_family", "row_count"))


def path_expressions(spark, folder):
    """Path segments, file names, suffixes, list membership and JSON text on the pages' addresses."""
    p = table(spark, folder, "pages")
    path = F.concat(F.lit("raw/lang="), F.split("url", "/")[3], F.lit("/page="), F.col("page_id"), F.lit("/"), F.col("url"), F.lit(".done"))
    typed = with_path_keys(p.withColumn("path", path), {"lang": "string", "page": "bigint"})
    props = F.create_map(F.lit("run.url"), F.col("url"), F.lit("owner"), F.lit("x"))
    return typed.select(
        "page_id",
        "lang",
        "page",
        path_key(F.col("path"), "page", "int").alias("page_int"),
        strip_suffix(file_name(F.col("path")), ".done").alias("last_part"),
        in_csv(F.col("lang"), F.lit("en,fr")).alias("listed"),
        json_string(F.col("url")).alias("quoted"),
        F.size(map_with_prefix(props, "run.")).alias("run_entries"),
        map_get(props, "missing").alias("missing"),
    )


QUERIES = {
    "latest_snapshot": latest_snapshot,
    "run_status": run_status,
    "last_runs": last_runs,
    "table_inventory": table_inventory,
    "inventory_matrix": inventory_matrix,
    "inventory_matrix_filtered": inventory_matrix_filtered,
    "choices": choices,
    "param_filter": param_filter,
    "time_filter": time_filter,
    "row_count_snapshot": row_count_snapshot,
    "row_count_series": row_count_series,
    "sentinels": sentinels,
    "sentinel_coverage": sentinel_coverage,
    "schema_drift": schema_drift,
    "drift_list": drift_list,
    "freshness": freshness,
    "freshness_bands": freshness_bands,
    "value_mapping": value_mapping,
    "value_mapping_table": value_mapping_table,
    "series_reduce": series_reduce,
    "preview": preview,
    "run_sql": run_sql,
    "readiness_report": readiness_report,
    "run_readiness": run_readiness,
    "readiness_snapshots": readiness_snapshots,
    "path_expressions": path_expressions,
}

SQL = {
    "latest_snapshot": """
        SELECT *, date_trunc('day', ts)::TIMESTAMP AS collected_at FROM events
        WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)""",
    "run_status": f"""
        SELECT {NOW_SQL} AS collected_at, 'lake' AS catalog, {_RUN_COLUMNS},
               event_type IN ('error', 'view') AS parse_error
        FROM events""",
    "last_runs": f"""
        SELECT {_RUN_COLUMNS} FROM events
        WHERE event_type = 'purchase'
          AND date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)
        ORDER BY schema_name""",
    "table_inventory": f"SELECT {NOW_SQL} AS collected_at, 'lake' AS catalog, * FROM ({_INVENTORY_SQL})",
    "inventory_matrix": f"""
        SELECT schema_name, coalesce(CAST(cycle AS VARCHAR), 'N/A') AS cycle, count(*) AS table_count
        FROM ({_INVENTORY_SQL}) GROUP BY ALL ORDER BY 1, 2""",
    "inventory_matrix_filtered": f"""
        SELECT schema_name, CAST(cycle AS VARCHAR) AS cycle, count(*) AS table_count,
               CASE WHEN count(*) >= 10 THEN 'green' WHEN count(*) >= 1 THEN 'yellow' ELSE 'red' END AS colour
        FROM ({_INVENTORY_SQL}) WHERE cycle = 1998 AND schema_name IN ('1-urgent', '5-low')
        GROUP BY schema_name, cycle""",
    "choices": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS cycle FROM orders ORDER BY 1 DESC",
    "param_filter": """
        SELECT *, CAST(year(o_orderdate) AS INTEGER) AS cycle FROM orders
        WHERE year(o_orderdate) = 1999 AND o_orderstatus IN ('F', 'O')""",
    "time_filter": """
        SELECT * FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00'""",
    "row_count_snapshot": f"""
        SELECT {NOW_SQL} AS collected_at, 'lake' AS catalog, lower(l_returnflag) AS schema_name,
               'ship_' || year(l_shipdate) AS table_name, CAST(year(l_shipdate) AS INTEGER) AS cycle,
               count(*) AS row_count
        FROM lineitem
        WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders)
        GROUP BY l_returnflag, year(l_shipdate)""",
    "row_count_series": """
        SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS "time",
               lower(l_returnflag) || CASE WHEN l_linestatus = 'O' THEN ' / ' || year(l_shipdate) ELSE '' END AS metric,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
        FROM lineitem
        WHERE date_trunc('month', l_shipdate) BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-01'
          AND l_returnflag IN ('A', 'R')
        GROUP BY 1, 2""",
    "sentinels": _MARKERS_SQL,
    "sentinel_coverage": f"""
        SELECT cycle, count(*) AS sentinel_count, min(month) AS earliest_month, max(month) AS latest_month,
               CASE WHEN count(*) >= 6 THEN 'green' WHEN count(*) >= 1 THEN 'yellow' ELSE 'red' END AS colour
        FROM ({_MARKERS_SQL}) GROUP BY cycle ORDER BY cycle DESC""",
    "schema_drift": _DRIFT_SQL,
    "drift_list": f"""
        SELECT form_family, cycle, in_registry, 'MISSING' AS label FROM ({_DRIFT_SQL})
        WHERE NOT in_registry AND cycle = 2010 ORDER BY cycle DESC, form_family""",
    "freshness": _FRESHNESS_SQL,
    "freshness_bands": f"""
        SELECT table_name, age_hours,
               CASE WHEN age_hours >= 72 THEN 'red' WHEN age_hours >= 24 THEN 'yellow' ELSE 'green' END AS colour
        FROM ({_FRESHNESS_SQL})""",
    "value_mapping": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label
        FROM orders""",
    "value_mapping_table": """
        SELECT c_custkey, c_nationkey, coalesce(n_name, 'unknown') AS nation
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "series_reduce": """
        SELECT user_id, arg_max(value, ts) FILTER (event_type <> 'error') AS last_value,
               max(value) FILTER (event_type <> 'error') AS max_value,
               count(value) FILTER (event_type <> 'error') AS samples
        FROM events GROUP BY user_id""",
    "preview": """
        SELECT *, (SELECT count(*) > 1000 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000""",
    "run_sql": """
        SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders WHERE o_totalprice >= 100000.0 AND o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority""",
    "readiness_report": f"""
        WITH series AS (
            SELECT DISTINCT date_trunc('month', l_shipdate) AS t, l_returnflag,
                   CASE WHEN l_linestatus = 'O' THEN year(l_shipdate) END AS cycle
            FROM lineitem
            WHERE date_trunc('month', l_shipdate) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2002-12-01')
        SELECT 'last_runs' AS panel, count(*) AS rows FROM events
        WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)
        UNION ALL SELECT 'inventory', count(*) FROM (SELECT DISTINCT schema_name, cycle FROM ({_INVENTORY_SQL}))
        UNION ALL SELECT 'sentinels', count(DISTINCT cycle) FROM ({_MARKERS_SQL})
        UNION ALL SELECT 'row_counts', count(*) FROM series
        UNION ALL SELECT 'row_count_legend', count(*) FROM (SELECT DISTINCT l_returnflag, cycle FROM series)
        UNION ALL SELECT 'drift', count(*) FROM ({_DRIFT_SQL}) WHERE NOT in_registry
        UNION ALL SELECT 'freshness', count(*) FROM ({_FRESHNESS_SQL})
        UNION ALL SELECT 'cycles', count(DISTINCT cycle) FROM ({_INVENTORY_SQL})
        UNION ALL SELECT 'schemas', count(DISTINCT schema_name) FROM ({_INVENTORY_SQL})""",
    "readiness_snapshots": f"""
        WITH lines AS (SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY 1)
        SELECT {NOW_SQL} AS collected_at, 'lake' AS catalog, schema_name, table_name, cycle, form_family, row_count
        FROM ({_INVENTORY_SQL}) LEFT JOIN lines ON l_orderkey = CAST(regexp_extract(table_name, '_(\\d+)_', 1) AS BIGINT)""",
    "run_readiness": f"""
        WITH added AS (
            SELECT 'run_status' AS collector, count(*) AS rows FROM events
            UNION ALL SELECT 'table_inventory', count(*) FROM orders
            UNION ALL SELECT 'row_counts', count(DISTINCT l_orderkey) FROM lineitem
            UNION ALL SELECT 'sentinels', count(*) FROM ({_MARKERS_SQL})
            UNION ALL SELECT 'schema_drift', count(*) FROM ({_DRIFT_SQL})
            UNION ALL SELECT 'freshness', count(*) FROM ({_FRESHNESS_SQL}))
        SELECT collector, CASE WHEN run = 1 THEN rows ELSE 0 END AS rows, 'ok' AS status,
               CAST(NULL AS VARCHAR) AS error, CAST(run AS INTEGER) AS run
        FROM added, (VALUES (1), (2)) runs(run)""",
    "path_expressions": """
        SELECT page_id, split_part(url, '/', 4) AS lang, page_id AS page, CAST(page_id AS INTEGER) AS page_int,
               string_split(url, '/')[-1] AS last_part, split_part(url, '/', 4) IN ('en', 'fr') AS listed,
               '"' || url || '"' AS quoted, CAST(1 AS INTEGER) AS run_entries, CAST(NULL AS VARCHAR) AS missing
        FROM pages""",
}
