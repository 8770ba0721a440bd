"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from itertools import count, islice
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the contracts are runs of anything but these; bytes.split() cuts at the same six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's Python files to the executors, once per application.

    For sessions whose workers were started without the package on their path.
    """
    app = spark.conf.get("spark.app.id")
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lakekit-"), "lakekit_files.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.addArtifacts(archive, pyfile=True)
    _SHIPPED.add(app)


def pieces(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `most_bytes` of text (one row at least), so that the
    Python objects made from a slice stay small whatever the batch size of the session is."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        begin, held = 0, 0
        for at, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def give_back() -> None:
    """Returns what this process no longer uses to the system: Arrow's pool and the C heap's free pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives memory back: it may wait long for a task, of another kind."""

    def lighter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lighter


def free_names(taken: Sequence[str], n: int) -> list[str]:
    """`n` column names that differ from all of `taken`, whatever their case."""
    used = {c.lower() for c in taken}
    return list(islice((name for name in (f"_own{i}" for i in count()) if name not in used), n))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one scan on the JVM, one number back."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("n")).first()["n"]


def spread(n: int, *columns: Column | str) -> Column:
    """A bucket from 0 to n - 1 from the values of `columns`; a re-run task gives the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return (F.size(parts) - F.size(F.filter(F.slice(parts, 1, 1), lambda p: p == "")) - ends_in_space(text)).cast("long")


def ends_in_space(text: Column) -> Column:
    """1 for a text with a word and white space behind the last one, else 0: split leaves an empty part there."""
    safe = F.coalesce(text, F.lit(""))
    return F.when(safe.rlike(r"[^\x20\x09-\x0D][\x20\x09-\x0D]+\z") | safe.rlike(r"\A[\x20\x09-\x0D]+\z"), 1).otherwise(0)
