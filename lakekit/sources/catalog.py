"""Registered tables and catalog contents.

The session catalog has no domain level, so a table of two domains may collide on one
`schema.table` name. The domain is therefore carried as a column and a collision is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

NAME = re.compile(r"^[A-Za-z0-9_-]+$")
FILE_FORMATS = ("parquet", "csv", "json", "orc", "text", "avro")
VERSION_MARK = "__v"
VERSION = re.compile(VERSION_MARK + r"(\d{20}[0-9a-f]{8}|[0-9a-f]{32})$")
TABLE_KEY = "lakekit.table"


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def view_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Properties of a registered view or table; empty when there is none."""
    if not spark.catalog.tableExists(name):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def physical_name(spark: SparkSession, name: str) -> str:
    """The table behind a published name; the name itself when it is a table."""
    return view_properties(spark, name).get(TABLE_KEY, name)


def provider(spark: SparkSession, name: str) -> str:
    """Format a table was registered with."""
    described = spark.sql(f"DESCRIBE EXTENDED {quoted(physical_name(spark, name))}")
    found = [r["data_type"] for r in described.collect() if r["col_name"] == "Provider"]
    if not found:
        raise ValueError(f"{name} has no provider")
    return found[0].lower()


def read_registered(spark: SparkSession, name: str) -> DataFrame:
    """Read a table by the format it was registered with."""
    fmt = provider(spark, name)
    if fmt == "delta":
        try:
            spark._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
        except Exception as missing:
            raise ValueError(f"{name} is a delta table and the delta jar is not loaded") from missing
    elif fmt not in FILE_FORMATS:
        raise ValueError(f"{name} has unsupported format {fmt}")
    return spark.table(name)


def qualify(domain: str, schema: str, table: str) -> tuple[str, str]:
    """`(domain, schema.table)` after checking every segment's characters."""
    for part in (domain, schema, table):
        if not NAME.match(part or ""):
            raise ValueError(f"bad name segment: {part!r}")
    return domain, f"{schema}.{table}"


def read_many(spark: SparkSession, names: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Union several tables by column name, with `source_domain, source_schema, source_table`."""
    owners: dict[str, str] = {}
    union = None
    for domain, schema, table in names:
        _, name = qualify(domain, schema, table)
        if name.lower() in owners:
            raise ValueError(f"{name} is claimed by {owners[name.lower()]} and {domain}")
        owners[name.lower()] = domain
        part = spark.table(name).withColumns(
            {
                "source_domain": F.lit(domain),
                "source_schema": F.lit(schema),
                "source_table": F.lit(table),
            }
        )
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    if union is None:
        raise ValueError("no tables named")
    return union


def catalog_tables(spark: SparkSession, schemas: Sequence[str]) -> DataFrame:
    """`(schema_name, table_name, table_type)`; metadata only, one catalog call per schema.

    Physical tables behind a published name are left out.
    """
    found = [
        (schema, t.name, t.tableType)
        for schema in schemas
        if spark.catalog.databaseExists(schema)
        for t in spark.catalog.listTables(schema)
        if not t.isTemporary and not VERSION.search(t.name)
    ]
    return spark.createDataFrame(found, "schema_name string, table_name string, table_type string")


def schema_properties(spark: SparkSession, schemas: Sequence[str] | None = None) -> DataFrame:
    """`(name, properties)` of the databases, properties as a map."""
    names = schemas if schemas is not None else [d.name for d in spark.catalog.listDatabases()]
    out = []
    for name in names:
        described = spark.sql(f"DESCRIBE DATABASE EXTENDED {quoted(name)}").collect()
        text = next((r["info_value"] for r in described if r["info_name"] == "Properties"), "")
        # shown as ((key,value), (key,value)); a value may hold parentheses and commas
        inner = re.sub(r"^\(\(|\)\)$", "", text.strip())
        pairs = re.split(r"\),\s*\((?=[^,()\s]+,)", inner) if inner else []
        out.append((name, dict(p.split(",", 1) for p in pairs if "," in p)))
    schema = StructType(
        [
            StructField("name", StringType(), False),
            StructField("properties", MapType(StringType(), StringType()), False),
        ]
    )
    return spark.createDataFrame(out, schema)
