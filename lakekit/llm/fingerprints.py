"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is five words in a row; a text with fewer words is one shingle, a text without words has
none. The fingerprint is the `K` smallest distinct hashes of the shingles, sorted, as base64 of eight
bytes each. Sketches of parts merge into the sketch of the whole by keeping the smallest again. From
two sketches come estimates of resemblance (shared shingles over all), of containment and of the
number of distinct shingles; they are exact while there are fewer than `K`, else the error of the
resemblance is about `sqrt(r (1 - r) / K)`, at most 0.045. Equal texts have equal fingerprints. Two
texts without words resemble each other fully, and no other text at all.

Null text is empty. Rows are kept, repeated ones too, and an empty table stays empty; columns other
than the named ones are not looked at, whatever their names. Very long texts are one row each; a
task holds the words of one slice of texts at a time.

Order in `with_edited`: ids descending, null ids last, rows of equal id by the MD5 of their text.
Which equal row follows which makes no difference. Rows are dealt over ranges of that order by their
bytes, and the first rows of every range are sent to the range before as well, so no task orders the
table. Texts of which very many equal rows exist follow themselves; one row each goes that way.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path
from .common import pieces

K = 128
SIZE = 5
# Constants of the hash: a polynomial in MULTIPLIER over the words' hashes, then one scrambling step.
MULTIPLIER = 2305843009213693921
SCRAMBLE = 4417276706812531889
# Entries of a worker's table of word hashes; it changes the time only.
REMEMBERED = 1 << 17
# Bytes of text in a range, and at most so many ranges besides one per task.
RANGE_BYTES, RANGES = 24 << 20, 20_000
# Equal rows up to this number (or a 100,000th of all) go through like others.
COPIES = 10_000


class _Words(dict):
    """Hash of a word: the first eight bytes of its MD5."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")
        self[word] = value
        return value


def sketch(text: bytes, words: _Words, k: int = K, size: int = SIZE) -> np.ndarray:
    """The `k` smallest distinct shingle hashes of a text, sorted."""
    cut = text.split()
    if not cut:
        return np.empty(0, dtype=np.uint64)
    if len(words) > REMEMBERED:
        words.clear()
    each = np.fromiter(map(words.__getitem__, cut), dtype=np.uint64, count=len(cut))
    width = min(size, len(each))
    many = len(each) - width + 1
    h = np.zeros(many, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(MULTIPLIER) + each[i : i + many]
    h ^= h >> np.uint64(32)
    h *= np.uint64(SCRAMBLE)
    h ^= h >> np.uint64(29)
    return np.unique(h)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both texts."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of `a` that `b` has too; 1 if `a` has none."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode("ascii")


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=">u8").astype(np.uint64)


def sketch_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """`id_col` and `fingerprint` of every row."""
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for piece in pieces(batches, 1):
            prints = [encode(sketch(t, words, k)) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def merge_parts(parts: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One `fingerprint` per key from the fingerprints of its parts.

    Parts are merged where they are, then dealt by key and a hash, then by key; every step reads its
    rows in order and holds one sketch, so a key may have any number of parts.
    """
    keys = list(keys)
    rows = parts.select(*keys, "fingerprint")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                this = tuple(row[c] for c in keys)
                part = decode(row["fingerprint"] or "")
                if held is not None and this == key:
                    held = merged(held, part, k)
                    continue
                if held is not None:
                    done.append((*key, encode(held)))
                key, held = this, merged(part, part, k)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), batch.schema.types)], schema=batch.schema)
            last = batch.schema
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, encode(held)), last.types)], schema=last)

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    local = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys).select(*rows.columns).mapInArrow(run, schema)
    return local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _place(id_col: str, text: Column) -> Column:
    """A string that sorts like the order of documents: null flag, id descending, MD5 of the text."""
    number = F.bitwise_not(F.col(f"`{id_col}`").cast("bigint")).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(
        F.when(F.col(f"`{id_col}`").isNull(), "1").otherwise("0"), F.coalesce(F.lpad(F.hex(number), 16, "0"), F.lit("")), F.md5(text.cast("binary"))
    )


def _cuts(places: DataFrame, each: int) -> list[str]:
    """Places at which ranges of about `each` bytes begin, the first place included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = each
        for batch in batches:
            found = []
            for place, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= each:
                    found.append(place)
                    held = 0
                held += size
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["place"])

    ordered = places.select("place", "size").repartitionByRange("place").sortWithinPartitions("place")
    return sorted(r["place"] for r in ordered.mapInArrow(run, "place string").collect())


COLUMNS = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, times bigint"
)


class _Pair:
    """A text and its sketch; `before` gives the row of this text when another one follows."""

    def __init__(self, key: int | None, text: str, words: _Words):
        self.key, self.text, self.words = key, text, words
        self.sketch = sketch(text.encode("utf-8"), words)

    def before(self, after: _Pair, times: int) -> tuple:
        half = len(self.text) // 2
        edited = (self.text[: len(self.text) - half] + after.text[:half]).encode("utf-8")
        other = sketch(edited, self.words)
        return (
            self.key,
            len(self.text),
            hashlib.sha256(edited).hexdigest(),
            encode(self.sketch),
            encode(other),
            resemblance(self.sketch, other),
            resemblance(self.sketch, after.sketch),
            times,
        )


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `(bucket, guest, id, text)` in order: each one but guests, with the one that follows in its bucket."""
    words, last, at = _Words(), None, None
    for piece in pieces(batches, 3, 1 << 20):
        out = []
        for bucket, guest, key, text in zip(*(c.to_pylist() for c in piece.columns)):
            now = _Pair(key, text, words)
            if last is not None and at == bucket:
                out.append(last.before(now, 1))
            last, at = (None if guest else now), bucket
        if out:
            yield _as_batch(out)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its edited text: `id_col`, `n_chars` (code points), `edited_sha256`,
    `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`.

    In the edited text the last floor(n_chars / 2) code points are replaced by the first as many (or
    all) of the next document in the order above, the first one following the last. `near_edited` and
    `near_next` are the resemblance of the fingerprint to that of the edited text and of the next document.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"), _place(id_col, text).alias("place"))
    narrow = rows.select("place", F.octet_length("text").alias("size")).groupBy("place").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    places = scratch_path(spark, "places")
    narrow = materialise(narrow, places)
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * (F.col("size") + 100)), F.lit(0)).alias("size")).first()
    limit = max(COPIES, total["n"] // 100_000)
    weight = F.when(F.col("n") > limit, 1).otherwise(F.col("n")) * (F.col("size") + 100)
    cuts = _cuts(narrow.select("place", weight.alias("size")), max(RANGE_BYTES, total["size"] // RANGES)) or [""]
    starts = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def range_of(column: pa.Array) -> pa.Array:
        return pa.array([bisect_right(starts.value, p) - 1 for p in column.to_pylist()], pa.int32())

    @F.arrow_udf("boolean")
    def begins(column: pa.Array) -> pa.Array:
        return pc.is_in(column, pa.array(starts.value, pa.string()))

    # fewer than 100,000 places can have more than a 100,000th of the rows
    many = narrow.filter(F.col("n") > limit).select("place", "n")
    once = rows
    parts = []
    if many.isEmpty():
        delete_path(spark, places)
    else:
        many = F.broadcast(many)
        one = rows.join(many, "place").groupBy("place").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.max("n").alias("n"))
        one = materialise(one, scratch_path(spark, "copies"))
        once = rows.join(many, "place", "left_anti").unionByName(one.select("id", "text", "place"))
        parts.append(_following_themselves(one))
    dealt = once.select("id", "text", "place", range_of("place").alias("bucket"), begins("place").alias("begins"))
    own = F.struct("bucket", F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(cuts))).alias("bucket"), F.lit(True).alias("guest"))
    seats = F.explode(F.when(F.col("begins"), F.array(own, before)).otherwise(F.array(own)))
    seated = dealt.select("id", "text", "place", seats.alias("seat")).select("seat.*", "id", "text", "place")
    ordered = seated.repartitionById(len(cuts), F.col("bucket")).sortWithinPartitions("bucket", "guest", "place", "text")
    found = ordered.select("bucket", "guest", "id", "text").mapInArrow(_in_order, COLUMNS)
    for part in parts:
        found = found.unionByName(part)
    return found.drop("times").withColumnRenamed("id", id_col)


def _following_themselves(one: DataFrame) -> DataFrame:
    """The rows of texts of which `n` equal rows exist, all but the last: each is followed by an equal one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for piece in pieces(batches, 1, 1 << 20):
            out = []
            for key, text, n in zip(*(c.to_pylist() for c in piece.columns)):
                pair = _Pair(key, text, words)
                out.append(pair.before(pair, n - 1))
            if out:
                yield _as_batch(out)

    found = one.select("id", "text", "n").mapInArrow(run, COLUMNS)
    names = [c for c in found.columns if c != "times"]
    # dealt by thousands, so that no task writes all copies of a text
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000)))
    dealt = found.select(*names, "times", parts.alias("part")).repartition("part")
    times = F.least(F.col("times") - F.col("part") * 1000, F.lit(1000)).cast("int")
    return dealt.select(*names, F.explode(F.array_repeat(F.col("times"), times)).alias("times"))
