"""Helpers of the query bindings."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.files import read_path

# The moment all bindings take as now.
NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_path(spark, f"{folder}/{name}.parquet")


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as in the test tables."""
    cast = {
        f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"
    }
    return df.withColumns(cast) if cast else df


def fresh_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A table name nobody uses yet and a root for it in the shared folder."""
    root = scratch_path(spark, label)
    return f"default.{label}_{root[-12:]}", root
