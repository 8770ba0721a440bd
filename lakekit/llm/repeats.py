"""Removal of word sequences that occur elsewhere, found from fixed-block anchors.

Every document is cut into blocks that do not overlap; they are the index. Every rolling window of a
block's width, of every document, probes it. A block is half as wide as the least repeat, so a repeat
holds a whole block of each document it lies in, and both documents meet at that block's hash. The
hits are then extended: a place is compared over all windows of the least length around its anchor,
and neighbouring windows that occur elsewhere join into maximal repeats. Occurrences are compared as
classes of equal hashes, never as pairs, so a thousand copies cost a thousand rows.

Documents are dealt into chunks by a hash. A chunk sends its distinct hashes, packed, to buckets by
their upper bits; a bucket counts them over all chunks and answers with one bit per hash. Both steps,
anchors and windows, work like this, and the texts move once.

Words are runs of anything but the six ASCII white-space characters. Null or empty texts have no
words. Rows are kept as they are; a row that is there twice repeats itself. An empty table gives an
empty result. Extra columns do not matter, since only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .common import spread, text_bytes

CHUNK_BYTES = 6_000_000
BUCKET_BYTES = 10_000_000
LEAST_CHUNKS = 64
# bits of a block's hash that are sent besides its bucket; a chance hit costs time and changes nothing
BLOCK_BITS = 40

BLOBS = "phase int, bucket int, chunk int, n int, hashes binary, often binary, block binary"
ANSWERS = "phase int, bucket int, chunk int, n int, answer binary"


class Chunk:
    """The words of some documents as one array of hashes."""

    def __init__(self, texts: list, window: int, bits: int):
        self.window, self.bits, self.width = window, bits, (window + 1) // 2
        self.texts = [t.encode("utf-8") if t else b"" for t in texts]
        parts = [packing.word_hashes(t.split()) for t in self.texts]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.hashes = np.concatenate([np.empty(0, dtype=np.uint64), *parts])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def _within(self, width: int) -> np.ndarray:
        """Places of all windows of `width` words that lie in one document."""
        n = len(self.hashes)
        inside = np.arange(n) + width <= np.repeat(self.ends, self.sizes)
        return np.flatnonzero(inside)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of all rolling windows of a block's width, and which are blocks of the index."""
        at = self._within(self.width)
        hashes = packing.window_hashes(self.hashes, self.width)[at]
        block = (at - np.repeat(self.starts, self.sizes)[at]) % self.width == 0
        return at, hashes, block

    def windows(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows around the places in `hits`, their hashes, and second hashes for the buckets."""
        n = len(self.hashes)
        reach = np.zeros(n + 1, dtype=np.int64)
        np.add.at(reach, np.maximum(hits - (self.window - self.width), 0), 1)
        np.add.at(reach, hits + 1, -1)
        at = self._within(self.window)
        at = at[np.cumsum(reach)[at] > 0]
        first = packing.window_hashes(self.hashes, self.window)
        second = packing.window_hashes(self.hashes, self.window, 0xA0761D6478BD642F)
        return at, first[at], second[at] >> np.uint64(64 - self.bits)


def blob_rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    return pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)


BLOB_SCHEMA = pa.schema(
    [(n, pa.int32()) for n in ("phase", "bucket", "chunk", "n")] + [(n, pa.binary()) for n in ("hashes", "often", "block")]
)
ANSWER_SCHEMA = pa.schema([(n, pa.int32()) for n in ("phase", "bucket", "chunk", "n")] + [("answer", pa.binary())])


def _distinct(hashes: np.ndarray, block: np.ndarray | None = None):
    """Sorted distinct hashes, which of them occur more than once, and which are blocks."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    often = np.diff(np.append(at, len(ordered))) > 1
    is_block = np.maximum.reduceat(block[order], at) if block is not None and len(at) else np.zeros(len(at), dtype=bool)
    return ordered[at], often, is_block


def _send_anchors(key: int, chunk: Chunk) -> pa.Table:
    _, hashes, block = chunk.anchors()
    distinct, often, is_block = _distinct(hashes, block)
    cuts = packing.cuts_by_bucket(distinct, chunk.bits)
    rows = []
    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            packed = packing.pack(distinct[a:b], chunk.bits, BLOCK_BITS)
            rows.append((1, bucket, key, int(b - a), packed, packing.flags(often[a:b]), packing.flags(is_block[a:b])))
    return blob_rows(rows, BLOB_SCHEMA)


def answers_of(answers: pa.Table, phase: int) -> dict[int, np.ndarray]:
    columns = [answers.column(c).to_pylist() for c in ("phase", "bucket", "n", "answer")]
    return {b: packing.unflag(bits, n) for p, b, n, bits in zip(*columns) if p == phase}


def _hits(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """Places whose block-wide window is a block somewhere and occurs elsewhere."""
    at, hashes, _ = chunk.anchors()
    distinct, _, _ = _distinct(hashes)
    cuts = packing.cuts_by_bucket(distinct, chunk.bits)
    found = [distinct[cuts[b] : cuts[b + 1]][bits] for b, bits in sorted(answers_of(answers, 1).items())]
    hot = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
    if not len(hot):
        return np.empty(0, dtype=np.int64)
    where = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return at[hot[where] == hashes]


def _windows_by_bucket(chunk: Chunk, answers: pa.Table):
    """Places of the windows to compare, and per bucket their distinct hashes and which are frequent."""
    at, hashes, bucket = chunk.windows(_hits(chunk, answers))
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange((1 << chunk.bits) + 1, dtype=np.uint64))
    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if i < j:
            mine = order[i:j]
            yield b, at[mine], hashes[mine], _distinct(hashes[mine])


def _send_windows(key: int, chunk: Chunk, answers: pa.Table) -> pa.Table:
    rows = []
    for bucket, _, _, (distinct, often, _) in _windows_by_bucket(chunk, answers):
        rows.append((2, bucket, key, len(distinct), b"\x08" + distinct.astype("<u8").tobytes(), packing.flags(often), b""))
    return blob_rows(rows, BLOB_SCHEMA)


def count_blobs(blobs: pa.Table) -> pa.Table:
    """For every blob of a bucket which of its hashes occur twice or more over all; blocks must be among the anchors."""
    phase, bucket, chunk, n, hashes, often, block = (blobs.column(c).to_pylist() for c in BLOB_SCHEMA.names)
    values = np.concatenate([packing.unpack(h) for h in hashes])
    total = 1 + np.concatenate([packing.unflag(o, k) for o, k in zip(often, n)]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    repeated = np.add.reduceat(total[order], at) > 1
    if phase[0] == 1:
        blocks = np.concatenate([packing.unflag(o, k) for o, k in zip(block, n)])
        repeated &= np.maximum.reduceat(blocks[order], at)
    answer = np.empty(len(values), dtype=bool)
    answer[order] = np.repeat(repeated, np.diff(np.append(at, len(ordered))))
    rows, begin = [], 0
    for p, b, c, k in zip(phase, bucket, chunk, n):
        part = answer[begin : begin + k]
        begin += k
        if part.any():
            rows.append((p, b, c, k, packing.flags(part)))
    return blob_rows(rows, ANSWER_SCHEMA)


def _remove(chunk: Chunk, answers: pa.Table) -> tuple[list[int], list[int], list[str], list[list[dict]]]:
    """Words, words removed, text left and removed spans (in words) of every document."""
    found = answers_of(answers, 2)
    change = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
    if found:
        for bucket, at, hashes, (distinct, _, _) in _windows_by_bucket(chunk, answers):
            if bucket in found:
                repeated = at[found[bucket][np.searchsorted(distinct, hashes)]]
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + chunk.window, -1)
    gone = np.cumsum(change)[:-1] > 0
    removed, kept, spans = [], [], []
    for text, begin, end in zip(chunk.texts, chunk.starts.tolist(), chunk.ends.tolist()):
        words, mine = text.split(), gone[begin:end]
        if mine.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            words = [w for w, g in zip(words, mine.tolist()) if not g]
        else:
            spans.append([])
        removed.append(int(mine.sum()))
        kept.append(b" ".join(words).decode("utf-8"))
    return chunk.sizes.tolist(), removed, kept, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """`(id_col, n_words, n_removed, kept_text, removed)`; `removed` lists spans of word places.

    Removed is every word covered by a window of `window` words that starts anywhere else as well,
    in the same document or another; all windows are judged on the texts as they come.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    volume = text_bytes(docs, text_col)
    chunks = max(LEAST_CHUNKS, -(-volume // CHUNK_BYTES))
    bits = packing.bucket_bits(volume, BUCKET_BYTES)
    schema = docs.select(F.col(f"`{id_col}`").alias("id")).schema
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    parts = docs.select(F.col(f"`{id_col}`").alias("id"), text, spread(chunks, F.col(f"`{id_col}`"), text).alias("chunk"))

    def texts_of(table: pa.Table) -> Chunk:
        return Chunk(table.column("text").to_pylist(), window, bits)

    # without type hints, from which Spark would guess another kind of function
    def send_anchors(key, table):
        return _send_anchors(key[0].as_py(), texts_of(table))

    def send_windows(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return blob_rows([], BLOB_SCHEMA)
        return _send_windows(key[0].as_py(), texts_of(table), answers)

    def finish(key, table, answers):
        n_words, removed, kept, spans = _remove(texts_of(table), answers)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                id_col: table.column("id"),
                "n_words": pa.array(n_words, type=pa.int64()),
                "n_removed": pa.array(removed, type=pa.int64()),
                "kept_text": pa.array(kept, type=pa.string()),
                "removed": pa.array(spans, type=span),
            }
        )

    by_chunk = parts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, BLOBS)
    first = anchors.groupBy("bucket").applyInArrow(count_blobs, ANSWERS)
    windows = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(send_windows, BLOBS)
    second = windows.groupBy("bucket").applyInArrow(count_blobs, ANSWERS)
    answers = first.unionByName(second)
    kind = schema["id"].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, out)
