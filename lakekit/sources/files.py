"""Paths, storage listings, row counts from footers, file streams and literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import file_name, path_key


def read_path(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, **options: str
) -> DataFrame:
    """Read a directory; the schema is inferred unless given."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def list_files(spark: SparkSession, root: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """Recursive listing `(path, name, length, modified_at)`; no file content is read.

    Folders whose name starts with `_` or `.` are skipped unless `root` names them, directly
    or by a glob such as `table/cycle=*/_months`. Spark's file sources pass over files of zero
    length; `list_markers` is for those.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root if isinstance(root, str) else list(root))
    )
    return listing.select(
        "path",
        file_name(F.col("path")).alias("name"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )


def list_markers(spark: SparkSession, glob: str) -> DataFrame:
    """Files matching `glob`, empty ones too: `(path, name, length, modified_at)`.

    For marker files, of which there is one per cycle and month. It is one metadata call on the
    driver, so it is not for listing data; use `list_files` there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    listed = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if s.isFile()]
    df = spark.createDataFrame(listed, "path string, length bigint, millis bigint")
    return df.select("path", file_name(F.col("path")).alias("name"), "length", F.timestamp_millis("millis").alias("modified_at"))


def with_path_keys(df: DataFrame, keys: Mapping[str, str], path: str = "path") -> DataFrame:
    """Add one typed column per `key=value` path segment; NULL when absent or malformed."""
    return df.withColumns({k: path_key(F.col(path), k, t) for k, t in keys.items()})


# schema and table of a file, past partition folders and a version folder
TABLE_PATTERN = r"/([^/]+)/([^/]+)/(?:(?:[0-9]{20}[0-9a-f]{8}|[0-9a-f]{32})/)?(?:[^/=]+=[^/]*/)*[^/]+$"


# Parquet by the reader that takes counts out of the footers
FOOTER_COUNTS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_count(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """`n`, the rows of all Parquet files below `path`, by their footers alone: a count costs as much as there are files.

    Reads in a session of its own, so the settings of the caller's stay as they are.
    """
    own = spark.newSession()
    for key, value in FOOTER_COUNTS.items():
        own.conf.set(key, value)
    reader = own.read.schema("_none string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    counted = reader.option("ignoreCorruptFiles", skip_corrupt).parquet(path).agg(F.count("*").alias("n"))
    # files without a row group give nothing to add up
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def row_counts(
    spark: SparkSession,
    root: str,
    table_pattern: str = TABLE_PATTERN,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Rows per table directory below `root/<schema>/<table>/`, all tables in one job.

    Below the table's directory there may be a version folder of this package and partition folders;
    a match of `table_pattern` begins with the two names. Columns: `(schema_name, table_name, row_count,
    files, corrupt_skipped)`. A table whose files are all empty counts 0; a table without files has
    no row here. An unreadable file is an error; with `skip_corrupt` such files are passed over and
    their table is flagged, which is found out at once.

    Counts come from footers. The driver knows one path per table, as the catalog does.
    """
    named = list_files(spark, root, "*.parquet").select(
        F.regexp_extract("path", table_pattern, 1).alias("schema_name"),
        F.regexp_extract("path", table_pattern, 2).alias("table_name"),
        "path",
    )
    before = F.substring("path", F.lit(1), F.regexp_instr("path", F.lit(table_pattern)) - 1)
    folders = (
        named.filter("schema_name <> ''")
        .select("schema_name", "table_name", F.concat_ws("/", before, "schema_name", "table_name").alias("folder"))
        .groupBy("schema_name", "table_name", "folder")
        .agg(F.count("*").alias("files"))
        .collect()
    )
    schema = "schema_name string, table_name string, row_count bigint, files bigint, corrupt_skipped boolean"

    def counted(folder: Row, skip: bool) -> DataFrame:
        n = footer_count(spark, folder["folder"], skip).select(F.col("n").alias("row_count"))
        fixed = {"schema_name": folder["schema_name"], "table_name": folder["table_name"], "files": folder["files"], "corrupt_skipped": skip}
        return n.withColumns({c: F.lit(v) for c, v in fixed.items()}).select(*[f.split(" ")[0] for f in schema.split(", ")])

    def all_of(found: list[DataFrame]) -> DataFrame:
        # halves, so that the plan is as deep as the logarithm of their number
        while len(found) > 1:
            found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2])] + found[len(found) & ~1 :]
        one = ["schema_name", "table_name"]
        sums = [F.sum("row_count").alias("row_count"), F.sum("files").alias("files"), F.bool_or("corrupt_skipped").alias("corrupt_skipped")]
        return found[0].groupBy(*one).agg(*sums)

    if not folders:
        return spark.createDataFrame([], schema)
    if not skip_corrupt:
        return all_of([counted(f, False) for f in folders])

    def readable(folder: Row) -> bool:
        try:
            footer_count(spark, folder["folder"]).collect()
        except Exception:
            return False
        return True

    with ThreadPoolExecutor(8) as pool:
        whole = list(pool.map(readable, folders))
    return all_of([counted(f, not ok) for f, ok in zip(folders, whole)])


def rows(spark: SparkSession, data: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Typed in-memory rows."""
    return spark.createDataFrame(data, schema)


def stream_path(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """File stream with a declared schema; `max_files_per_trigger` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
