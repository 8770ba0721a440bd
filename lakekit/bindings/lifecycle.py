"""Table life cycle: tables are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import type_kind
from ..operators import buckets, descriptors, merge, tables
from ..sources import catalog, files
from ..session import scratch_path
from .common import fresh_table, table

# --- writing, replacing, overwriting ------------------------------------------------------------


def create_replace(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "created")
    tables.write_table(o.filter(F.col("o_orderstatus") == "F"), name, "create", root, partition_by=["o_orderstatus"])
    tables.write_table(o, name, "replace")
    tables.verify_write(o, name, key=["o_orderkey"])
    return spark.table(name)


def bootstrap_append(spark, folder):
    li = table(spark, folder, "lineitem")
    name, root = fresh_table(spark, "bootstrapped")
    tables.bootstrap_empty(spark, name, li.schema, root, ["l_returnflag"])
    tables.append(li, name)
    return spark.table(name)


def truncate(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "truncated")
    tables.write_table(o, name, "create", root)
    tables.truncate(spark, name)
    tables.append(o.filter(F.col("o_orderstatus") == "P"), name)
    return spark.table(name)


def overwrite_dynamic(spark, folder):
    li = table(spark, folder, "lineitem")
    name, root = fresh_table(spark, "dynamic")
    tables.write_table(li, name, "create", root, partition_by=["l_returnflag"])
    newer = li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
    tables.overwrite(newer, name, "dynamic")
    return spark.table(name)


def overwrite_where(spark, folder):
    li = table(spark, folder, "lineitem")
    name, root = fresh_table(spark, "matching")
    tables.write_table(li, name, "create", root)
    newer = li.filter(F.col("l_linestatus") == "O").withColumn("l_tax", F.lit(0.5))
    tables.overwrite(newer, name, "where", F.col("l_quantity") < 10)
    return spark.table(name)


def overwrite_all(spark, folder):
    li = table(spark, folder, "lineitem")
    name, root = fresh_table(spark, "everything")
    tables.write_table(li, name, "create", root, partition_by=["l_linestatus"])
    tables.overwrite(li.filter(F.col("l_discount") > 0.05), name)
    return spark.table(name)


def evolve(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "evolved")
    old = o.filter(F.col("o_orderstatus") == "F").drop("o_orderpriority")
    tables.write_table(old, name, "create", root)
    wider = old.select("*", F.lit("x").alias("o_orderpriority")).schema
    tables.evolve(spark, name, wider)
    tables.append(o.filter(F.col("o_orderstatus") != "F"), name)
    return spark.table(name)


def compact(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "compacted")
    tables.write_table(o.repartition(16), name, "create", root, partition_by=["o_orderstatus"])
    tables.compact(spark, name, 1024 * 1024)
    return spark.table(name)


def convert(spark, folder):
    e = table(spark, folder, "events")
    name, root = fresh_table(spark, "converted")
    tables.write_table(e, name, "create", root)
    for fmt in ("json", "csv", "orc"):
        tables.convert(spark, name, fmt)
    return catalog.read_registered(spark, name)


def read_many(spark, folder):
    names = []
    for kind, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        name, root = fresh_table(spark, kind)
        tables.write_table(table(spark, folder, kind), name, "create", root)
        names.append(("shop", *name.split(".")))
    union = catalog.read_many(spark, names)
    return union.select(
        F.split("source_table", "_")[0].alias("origin"), "source_domain", "c_custkey", "c_name", "s_suppkey", "s_name"
    )


def row_counts(spark, folder):
    """Counts per table directory from footers; one partitioned and one empty table among them."""
    root = fresh_table(spark, "counted")[1]
    table(spark, folder, "orders").write.partitionBy("o_orderstatus").parquet(f"{root}/shop/orders")
    table(spark, folder, "customer").write.parquet(f"{root}/shop/customer")
    table(spark, folder, "events").filter("false").write.parquet(f"{root}/web/events")
    counts = files.row_counts(spark, root)
    return counts.select("schema_name", "table_name", "row_count", "corrupt_skipped")


def list_files(spark, folder):
    """The files of a table written here, told apart by the partition in their path."""
    name, root = fresh_table(spark, "listed")
    tables.write_table(table(spark, folder, "lineitem"), name, "create", root, partition_by=["l_returnflag", "l_linestatus"])
    listed = files.list_files(spark, root, "*.parquet")
    keyed = files.with_path_keys(listed, {"l_returnflag": "string", "l_linestatus": "string"})
    per_partition = keyed.groupBy("l_returnflag", "l_linestatus")
    return per_partition.agg(F.bool_and((F.col("length") > 0) & F.col("name").endswith(".parquet")).alias("filled"))


def drop_recreate(spark, folder):
    """Dropped with its files, made again and filled with other rows."""
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "dropped")
    tables.write_table(o, name, "create", root)
    tables.drop(spark, name, purge=True)
    tables.drop(spark, name)
    tables.bootstrap_empty(spark, name, o.schema, root)
    tables.append(o.filter(F.col("o_orderstatus") == "P"), name)
    return spark.table(name)


def explicit_format(spark, folder):
    """A requested format that does not count: the session's default is used, the rows are the same."""
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "formatted")
    tables.write_table(o, name, "create", root, fmt="csv", honour_explicit=False)
    return spark.table(name).withColumn("format", F.lit(catalog.provider(spark, name)))


def failed_write(spark, folder):
    """A replacement that fails on the way: the table keeps its rows, and neither an entry nor files of the failure stay."""
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "failing")
    tables.write_table(o.filter(F.col("o_orderstatus") == "F"), name, "create", root)
    files_before = files.list_files(spark, root).select("path").collect()
    stop = F.when(F.col("o_orderstatus") == "P", F.raise_error(F.lit("stopped"))).otherwise(F.col("o_totalprice"))
    try:
        tables.write_table(o.withColumn("o_totalprice", stop.cast("double")), name, "replace")
        failed = False
    except Exception as error:
        failed = "stopped" in str(error)
    clean = sorted(files_before) == sorted(files.list_files(spark, root).select("path").collect())
    single = len(tables.versions(spark, name)) == 1
    return spark.table(name).withColumns({"failed": F.lit(failed), "cleaned": F.lit(clean and single)})


def catalog_listing(spark, folder):
    """A schema with a table per order status and its run's properties, listed with what they say and hold."""
    o = table(spark, folder, "orders")
    root = scratch_path(spark, "catalog")
    schema = f"shop_{root[-12:]}"
    states = [r[0] for r in o.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{root}' WITH DBPROPERTIES ('pipeline.last_run_table_count' = '{len(states)}')")
    for state in states:
        tables.write_table(o.filter(F.col("o_orderstatus") == state), f"{schema}.orders_{state.lower()}", "create", root)
    listed = catalog.catalog_tables(spark, [schema])
    said = catalog.schema_properties(spark, [schema]).select(
        F.col("name").alias("schema_name"), F.col("properties")["pipeline.last_run_table_count"].cast("int").alias("said_tables")
    )
    counts = files.row_counts(spark, root, rf"/({root.rsplit('/', 1)[-1]})/([^/]+)/").select("table_name", "row_count")
    return listed.join(said, "schema_name").join(counts, "table_name").select("table_name", "table_type", "said_tables", "row_count")


def typed_rows(spark, folder):
    """Orders per priority group of an in-memory table."""
    groups = files.rows(spark, [("1-URGENT", "soon", 1.5), ("2-HIGH", "soon", 1.0), ("5-LOW", None, 0.25)], "priority string, grp string, weight double")
    o = table(spark, folder, "orders").join(F.broadcast(groups), F.col("o_orderpriority") == F.col("priority"))
    return o.groupBy("grp").agg(F.count("*").alias("orders"), F.sum("weight").alias("weight"))


def describe_tables(spark, folder):
    """Descriptors of three tables, with the number of values that each column has."""
    out = None
    schemas = {t: table(spark, folder, t) for t in ("orders", "part", "events")}
    described = descriptors.describe_schema(spark, {t: d.schema for t, d in schemas.items()}, {"orders": ["o_orderstatus"]})
    for name, d in schemas.items():
        counts = d.agg(*[F.count(c).alias(c) for c in d.columns]).unpivot([], d.columns, "column_name", "filled")
        part = counts.withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    columns = ["table_name", "column_name", "type_text", "type_name", "position", "partition_index", "format", "filled"]
    return described.join(out, ["table_name", "column_name"]).select(*columns)


# --- key-wise writes ----------------------------------------------------------------------------


def append_absent(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "absent")
    finished = o.filter(F.col("o_orderstatus") == "F").withColumn("o_totalprice", F.lit(0.0))
    tables.write_table(finished, name, "create", root)
    merge.append_absent(o.unionByName(o), name, ["o_orderkey"])
    merge.append_absent(o, name, ["o_orderkey"])
    return spark.table(name)


def merge_by_key(spark, folder):
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "merged")
    tables.write_table(o.filter(F.col("o_orderstatus") != "P"), name, "create", root)
    source = (
        o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .withColumn("gone", F.col("o_totalprice") < 50000)
        .withColumn("o_totalprice", F.col("o_totalprice") * 2)
    )
    merge.merge_into(source, name, ["o_orderkey"], delete_flag="gone")
    return spark.table(name)


def merge_touched(spark, folder):
    """Urgent orders of finished and open state re-priced; the partition of the third state is not read."""
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "merged_parts")
    tables.write_table(o, name, "create", root, partition_by=["o_orderstatus"])
    urgent = o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P"))
    source = urgent.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    merge.merge_into(source, name, ["o_orderkey", "o_orderstatus"], touched_only=True)
    return spark.table(name)


def keyed_upsert(spark, folder):
    """Orders in hash buckets: corrections of one order in a hundred, some of them removals, and more buckets in the end."""
    o = table(spark, folder, "orders")
    name, root = fresh_table(spark, "bucketed")
    buckets.create_keyed(spark, name, o.schema, root, ["o_orderkey"], buckets=8)
    buckets.upsert(o, name)
    some = o.filter(F.col("o_orderkey") % 100 == 0)
    changed = some.withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("gone", F.col("o_orderstatus") == "P")
    buckets.upsert(changed, name, delete_flag="gone")
    buckets.grow(spark, name, 16)
    buckets.upsert(some.filter(F.col("o_orderstatus") == "F").withColumn("o_orderpriority", F.lit("0-NOW")), name)
    return spark.table(name)


def keyed_export(spark, folder):
    e = table(spark, folder, "events")
    name, root = fresh_table(spark, "exported")
    merge.keyed_export(e, name, "user_id", "replace", newest_by="ts", root=root)
    return catalog.read_registered(spark, name)


def keyed_export_upsert(spark, folder):
    e = table(spark, folder, "events")
    name, root = fresh_table(spark, "upserted")
    merge.keyed_export(e.filter(F.col("event_type") != "error"), name, "user_id", "replace", newest_by="ts", root=root)
    merge.keyed_export(e.filter(F.col("event_type") == "error"), name, "user_id", "upsert", newest_by="ts")
    return catalog.read_registered(spark, name)


def multiset_diff(spark, folder):
    """Keys whose number of orders differs from their number of line items."""
    left = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    right = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    return tables.multiset_diff(left, right)


# --- descriptors --------------------------------------------------------------------------------


def _descriptors(spark, folder, side):
    """Descriptors drawn from the parts: a table per brand and type, a column per size."""
    p = table(spark, folder, "part")
    pick = F.min if side == "existing" else F.max
    name = F.concat_ws("_", F.translate("p_brand", "#", "_"), F.lower("p_type"))
    position = F.col("p_size") - 1
    kind = F.when(F.col("p_size") > 40, "decimal(10,2)").when(F.col("p_size") > 20, "string").otherwise("bigint")
    # the requested side spells formats in capitals, wants some in orc, and swaps two partitions
    fmt = F.when(F.col("p_type") == "SMALL", "ORC").otherwise("PARQUET")
    swapped = F.when(F.col("p_type") == "PROMO", 2 - F.col("p_size")).otherwise(position)
    kept = p.filter(F.col("p_brand") != "Brand#7") if side == "existing" else p
    moved = F.when((F.col("p_type") == "LARGE") & F.lit(side == "requested"), "moved/").otherwise("")
    steady = F.col("p_type").isin("LARGE", "PROMO", "SMALL")
    described = kept.groupBy(name.alias("table_name"), "p_type", "p_size").agg(pick("p_name").alias("picked"))
    return described.select(
        "table_name",
        F.when(steady, F.concat(F.lit("col_"), F.col("p_size"))).otherwise(F.col("picked")).alias("column_name"),
        kind.alias("type_text"),
        position.alias("position"),
        F.lit(True).alias("nullable"),
        F.when(F.col("p_size") <= 2, position if side == "existing" else swapped).alias("partition_index"),
        (F.lit("parquet") if side == "existing" else fmt).alias("format"),
        F.concat(F.lit("/lake/"), moved, F.col("table_name")).alias("location"),
    )


def _descriptor_sql(side):
    new = side == "requested"
    index = "CASE WHEN p_type = 'PROMO' THEN 2 - p_size ELSE p_size - 1 END" if new else "p_size - 1"
    fmt = "CASE WHEN p_type = 'SMALL' THEN 'orc' ELSE 'parquet' END" if new else "'parquet'"
    moved = "CASE WHEN p_type = 'LARGE' THEN 'moved/' ELSE '' END" if new else "''"
    return f"""
        SELECT replace(p_brand, '#', '_') || '_' || lower(p_type) AS t,
               CASE WHEN p_type IN ('LARGE', 'PROMO', 'SMALL') THEN 'col_' || p_size
                    ELSE {'max' if new else 'min'}(p_name) END AS c,
               CASE WHEN p_size > 40 THEN 'decimal(10,2)' WHEN p_size > 20 THEN 'string' ELSE 'bigint' END AS ty,
               p_size - 1 AS pos, CASE WHEN p_size <= 2 THEN {index} END AS pi, {fmt} AS f,
               '/lake/' || {moved} || replace(p_brand, '#', '_') || '_' || lower(p_type) AS loc
        FROM part {'' if new else "WHERE p_brand <> 'Brand#7'"}
        GROUP BY p_brand, p_type, p_size"""


_PLAN_CTE = f"""
    WITH e AS ({_descriptor_sql('existing')}), r AS ({_descriptor_sql('requested')}),
    tables AS (
        SELECT coalesce(a.t, b.t) AS t, a.t AS in_e, b.t AS in_r, a.f AS ef, b.f AS rf,
               a.loc AS eloc, b.loc AS rloc, a.n AS en, b.n AS rn
        FROM (SELECT t, max(f) f, max(loc) loc, count(*) n FROM e GROUP BY t) a
        FULL JOIN (SELECT t, max(f) f, max(loc) loc, count(*) n FROM r GROUP BY t) b ON a.t = b.t),
    cols AS (
        SELECT coalesce(e.t, r.t) AS t, coalesce(e.pos, r.pos) AS pos,
               CASE WHEN e.t IS NULL THEN 'added' WHEN r.t IS NULL THEN 'removed'
                    WHEN e.c <> r.c THEN 'name' WHEN e.ty <> r.ty THEN 'type' END AS why
        FROM e FULL JOIN r ON e.t = r.t AND e.pos = r.pos),
    parts AS (
        SELECT coalesce(e.t, r.t) AS t, bool_or(e.c IS DISTINCT FROM r.c) AS differs
        FROM (SELECT * FROM e WHERE pi >= 0) e FULL JOIN (SELECT * FROM r WHERE pi >= 0) r
             ON e.t = r.t AND e.pi = r.pi GROUP BY 1),
    firsts AS (SELECT t, arg_min('column ' || pos || ' ' || why, pos) AS why FROM cols WHERE why IS NOT NULL GROUP BY t)"""


def _plan_sql(column_reason):
    return f"""{_PLAN_CTE}, reasons AS (
        SELECT tables.t AS table_name, in_e, in_r,
               CASE WHEN in_e IS NULL THEN 'missing' WHEN in_r IS NULL THEN 'not requested'
                    WHEN ef <> rf THEN 'format' WHEN {column_reason} IS NOT NULL THEN {column_reason}
                    WHEN differs THEN 'partitions' END AS reason
        FROM tables LEFT JOIN firsts USING (t) LEFT JOIN parts USING (t))
    SELECT table_name,
           CASE WHEN in_e IS NULL THEN 'create' WHEN in_r IS NULL THEN 'ignore'
                WHEN reason IS NULL THEN 'reuse' ELSE 'recreate' END AS action,
           reason
    FROM reasons"""


def plan_change(spark, folder):
    return descriptors.plan_change(_descriptors(spark, folder, "existing"), _descriptors(spark, folder, "requested"))


def plan_change_arity(spark, folder):
    return descriptors.plan_change(
        _descriptors(spark, folder, "existing"), _descriptors(spark, folder, "requested"), rule="arity"
    )


def registry_diff(spark, folder):
    return descriptors.registry_diff(_descriptors(spark, folder, "existing"), _descriptors(spark, folder, "requested"))


def partition_columns(spark, folder):
    """A table per brand and type; the ten largest sizes are its partition columns."""
    p = table(spark, folder, "part")
    desc = p.select(
        F.concat_ws("/", "p_brand", "p_type").alias("table_name"),
        F.concat(F.lit("size_"), F.col("p_size")).alias("column_name"),
        F.when(F.col("p_size") > 5, F.col("p_size") - 41).alias("partition_index"),
    )
    return descriptors.partition_columns(desc)


def descriptors_from_json(spark, folder):
    """A registry's answer per part: a key column, and a column partitioned by when the part is small."""
    p = table(spark, folder, "part")
    key = F.struct(F.lit("key").alias("name"), F.lit("bigint").alias("type_text"), F.lit(0).alias("position"))
    index = F.when(F.col("p_size") <= 25, F.lit(0)).alias("partition_index")
    nested = F.lit('{"name":"nested","position":7}').alias("type_json")
    kind = F.struct(
        F.lower("p_type").alias("name"), F.lit("string").alias("type_text"), nested, F.lit(1).alias("position"), index
    )
    text = F.concat(F.lit("["), F.to_json(key), F.lit(","), F.to_json(kind), F.lit("]"))
    answers = p.select(F.concat(F.lit("part_"), F.col("p_partkey")).alias("name"), text.alias("columns"))
    parsed = descriptors.descriptors_from_json(answers, "name", "columns")
    return parsed.select("table_name", "column_name", "type_text", "position", "partition_index")


def type_kinds(spark, folder):
    """Kinds of type texts built from the parts."""
    p = table(spark, folder, "part")
    n = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("decimal("), n, F.lit(",2)")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Varchar("), n, F.lit(")")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("array<decimal("), n, F.lit(",0)>")))
        .when(F.col("p_type") == "LARGE", F.lit("interval day to second"))
        .when(F.col("p_type") == "MEDIUM", F.when(F.col("p_size") > 25, "bigint").otherwise("timestamp_ntz"))
        .otherwise(F.lit("variant"))
    )
    return p.select("p_partkey", type_kind(text).alias("kind"))


def valid_names(spark, folder):
    return descriptors.valid_names(table(spark, folder, "documents"), "source").unionByName(
        descriptors.valid_names(table(spark, folder, "pages"), "url")
    )


def orphans(spark, folder):
    """Directories of customers against entries of customers with finished orders."""
    c = table(spark, folder, "customer")
    o = table(spark, folder, "orders").filter(F.col("o_totalprice") > 400000)
    place = lambda key: F.concat(F.lit("/lake/c"), F.col(key))
    listed = c.filter(F.col("c_acctbal") > 0).select(
        F.concat(place("c_custkey"), F.lit("/part-0.parquet")).alias("path"), F.col("c_nationkey").cast("bigint").alias("length")
    )
    entries = o.groupBy("o_custkey").agg(F.count("*")).select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("table_name"), F.concat(place("o_custkey"), F.lit("/")).alias("location")
    )
    return descriptors.orphans(listed, entries)


QUERIES = {
    "create_replace_roundtrip": create_replace,
    "bootstrap_append": bootstrap_append,
    "truncate": truncate,
    "overwrite_all": overwrite_all,
    "overwrite_dynamic": overwrite_dynamic,
    "overwrite_where": overwrite_where,
    "evolve": evolve,
    "compact": compact,
    "convert": convert,
    "read_many": read_many,
    "row_counts": row_counts,
    "list_files": list_files,
    "drop_recreate": drop_recreate,
    "explicit_format": explicit_format,
    "failed_write": failed_write,
    "catalog_listing": catalog_listing,
    "typed_rows": typed_rows,
    "describe_tables": describe_tables,
    "append_absent": append_absent,
    "merge_by_key": merge_by_key,
    "merge_touched": merge_touched,
    "keyed_upsert": keyed_upsert,
    "keyed_export": keyed_export,
    "keyed_export_upsert": keyed_export_upsert,
    "multiset_diff": multiset_diff,
    "plan_change": plan_change,
    "plan_change_arity": plan_change_arity,
    "registry_diff": registry_diff,
    "partition_columns": partition_columns,
    "descriptors_from_json": descriptors_from_json,
    "type_kinds": type_kinds,
    "valid_names": valid_names,
    "orphans": orphans,
}

def _describe_sql():
    """Names, types and places are the tables' declared ones; numbers of values are counted."""
    declared = {
        "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
        "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
        "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    }
    kinds = {"BIGINT": "LONG"}
    rows = []
    for name, columns in declared.items():
        for i, (column, kind) in enumerate(c.split(" ") for c in columns.split(", ")):
            index = "0" if column == "o_orderstatus" else "NULL"
            rows.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS type_text, '{kinds.get(kind, kind)}' AS type_name, "
                f"CAST({i} AS INTEGER) AS position, CAST({index} AS INTEGER) AS partition_index, 'parquet' AS format, count({column}) AS filled FROM {name}"
            )
    return " UNION ALL ".join(rows)


SQL = {
    "list_files": "SELECT DISTINCT l_returnflag, l_linestatus, true AS filled FROM lineitem",
    "drop_recreate": "SELECT * FROM orders WHERE o_orderstatus = 'P'",
    "explicit_format": "SELECT *, 'parquet' AS format FROM orders",
    "failed_write": "SELECT *, true AS failed, true AS cleaned FROM orders WHERE o_orderstatus = 'F'",
    "catalog_listing": """
        SELECT 'orders_' || lower(o_orderstatus) AS table_name, 'VIEW' AS table_type,
               CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS INTEGER) AS said_tables, count(*) AS row_count
        FROM orders GROUP BY o_orderstatus""",
    "typed_rows": """
        SELECT grp, count(*) AS orders, sum(weight) AS weight
        FROM orders JOIN (VALUES ('1-URGENT', 'soon', 1.5::DOUBLE), ('2-HIGH', 'soon', 1.0), ('5-LOW', NULL, 0.25)) g(priority, grp, weight)
          ON o_orderpriority = priority GROUP BY grp""",
    "describe_tables": _describe_sql(),
    "create_replace_roundtrip": "SELECT * FROM orders",
    "bootstrap_append": "SELECT * FROM lineitem",
    "truncate": "SELECT * FROM orders WHERE o_orderstatus = 'P'",
    "overwrite_all": "SELECT * FROM lineitem WHERE l_discount > 0.05",
    "overwrite_dynamic": "SELECT * FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 25",
    "overwrite_where": """
        SELECT * FROM lineitem WHERE l_quantity >= 10
        UNION ALL SELECT * REPLACE (0.5::DOUBLE AS l_tax) FROM lineitem WHERE l_linestatus = 'O'""",
    "evolve": """
        SELECT * REPLACE (CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority) FROM orders""",
    "compact": "SELECT * FROM orders",
    "convert": "SELECT * FROM events",
    "read_many": """
        SELECT 'customer' AS origin, 'shop' AS source_domain, c_custkey, c_name,
               CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM customer
        UNION ALL SELECT 'supplier', 'shop', NULL, NULL, s_suppkey, s_name FROM supplier""",
    "row_counts": """
        SELECT 'shop' AS schema_name, 'orders' AS table_name, count(*) AS row_count, FALSE AS corrupt_skipped FROM orders
        UNION ALL SELECT 'shop', 'customer', count(*), FALSE FROM customer
        UNION ALL SELECT 'web', 'events', 0, FALSE""",
    "append_absent": """
        SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice) FROM orders""",
    "merge_by_key": """
        SELECT * REPLACE (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice * 2
                               ELSE o_totalprice END AS o_totalprice)
        FROM orders
        WHERE CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice >= 50000
                   ELSE o_orderstatus <> 'P' END""",
    "merge_touched": """
        SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN o_totalprice * 2
                               ELSE o_totalprice END AS o_totalprice) FROM orders""",
    "keyed_upsert": """
        SELECT * REPLACE (
            CASE WHEN o_orderkey % 100 = 0 AND o_orderstatus <> 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
            CASE WHEN o_orderkey % 100 = 0 AND o_orderstatus = 'F' THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority)
        FROM orders WHERE NOT (o_orderkey % 100 = 0 AND o_orderstatus = 'P')""",
    "keyed_export": """
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
    "keyed_export_upsert": """
        SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, ts DESC, event_id) = 1""",
    "multiset_diff": """
        SELECT key, CAST(sum(side) AS BIGINT) AS n
        FROM (SELECT o_orderkey AS key, 1 AS side FROM orders UNION ALL SELECT l_orderkey, -1 FROM lineitem)
        GROUP BY key HAVING sum(side) <> 0""",
    "plan_change": _plan_sql("firsts.why"),
    "plan_change_arity": _plan_sql("(CASE WHEN en <> rn THEN 'column count' END)"),
    "registry_diff": f"""{_PLAN_CTE}
        SELECT tables.t AS table_name,
               coalesce(eloc <> rloc, FALSE) AS location_changed,
               in_e IS NOT NULL AND in_r IS NOT NULL AND firsts.why IS NOT NULL AS schema_changed,
               in_e IS NOT NULL AND in_r IS NOT NULL AND coalesce(differs, FALSE) AS partition_changed,
               CASE WHEN in_e IS NULL THEN 'left' WHEN in_r IS NULL THEN 'right' END AS missing_in
        FROM tables LEFT JOIN firsts USING (t) LEFT JOIN parts USING (t)""",
    "partition_columns": """
        SELECT p_brand || '/' || p_type AS table_name,
               list_transform(list_sort(coalesce(list(DISTINCT p_size) FILTER (p_size > 40), [])),
                              lambda s: 'size_' || s) AS cols
        FROM part GROUP BY p_brand, p_type""",
    "descriptors_from_json": """
        SELECT 'part_' || p_partkey AS table_name, 'key' AS column_name, 'bigint' AS type_text,
               CAST(0 AS INTEGER) AS position, CAST(NULL AS INTEGER) AS partition_index FROM part
        UNION ALL SELECT 'part_' || p_partkey, lower(p_type), 'string', 1, CASE WHEN p_size <= 25 THEN 0 END FROM part""",
    "type_kinds": """
        SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'DECIMAL' WHEN 'SMALL' THEN 'STRING' WHEN 'PROMO' THEN 'ARRAY'
               WHEN 'MEDIUM' THEN CASE WHEN p_size > 25 THEN 'LONG' ELSE 'TIMESTAMP_NTZ' END ELSE 'OTHER' END AS kind
        FROM part""",
    "valid_names": """
        SELECT name, coalesce(regexp_full_match(name, '[A-Za-z0-9_-]+'), FALSE) AS ok,
               CASE WHEN name IS NULL THEN 'null' WHEN name = '' THEN 'empty'
                    WHEN NOT regexp_full_match(name, '[A-Za-z0-9_-]+') THEN 'bad character' END AS reason
        FROM (SELECT source AS name FROM documents UNION ALL SELECT url FROM pages)""",
    "orphans": """
        WITH dirs AS (SELECT '/lake/c' || c_custkey AS location, 'c' || c_custkey AS t, c_nationkey AS n
                      FROM customer WHERE c_acctbal > 0),
        entries AS (SELECT DISTINCT 'c' || o_custkey AS t, '/lake/c' || o_custkey AS location
                    FROM orders WHERE o_totalprice > 400000)
        SELECT 'no entry' AS kind, location, CAST(NULL AS VARCHAR) AS table_name, CAST(1 AS BIGINT) AS files,
               CAST(n AS BIGINT) AS bytes FROM dirs WHERE t NOT IN (SELECT t FROM entries)
        UNION ALL SELECT 'no data', location, t, 0, 0 FROM entries WHERE t NOT IN (SELECT t FROM dirs)""",
}
