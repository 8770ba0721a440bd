"""Similarity join of documents on their word n-grams, in prefix trees of globally ordered sets.

A document's set is put in one order that all share: rare n-grams first, by the class of a count
taken over all documents, then by hash. Two sets that are similar enough share an n-gram among the
first few of each and are of similar size, so documents meet at keys of such an n-gram and a class of
sizes; a set has keys for its own class and for the next one, where the shorter of two needs fewer
n-grams. Two such sets share several keys of a class, up to four, when as many more n-grams are looked at.
Which keys occur in two sets is told by packed blobs of hashes; a set with too few of them in a class
has no partner there, and only the others go on. Chunks of documents are dealt by the smallest key, so
most near copies are in one chunk; those of a chunk that share keys go on as one unit, whose keys are
told once and not for every copy. The
keys of one cluster of near copies are many; they are led to one meeting place by passing on smallest
labels between keys and units. Whatever the labels are, all documents of a key go to the place it
names, so no pair is lost. Texts travel to their places; a table of bits of fixed size keeps most of
those that meet nobody from moving. Keys, postings and shuffles are the bulk of what is stored on the way;
each is removed once the step that reads it is stored.

At a meeting place the sets are stored in a trie and each is looked up in it. A path carries the
overlap of the whole subtree below it; a subtree is left when its lengths do not fit or when what
remains of the set and of the longest path cannot reach the overlap that is needed. Sets that are
already connected are passed over, so a group of g near copies gives about g links, not g squared.
A place with too much for one task is dealt into blocks that meet pair by pair. Of a place of very many
blocks each meets the first one at first; then only sets outside the largest component meet all others,
since sets of one component need not be compared. So the texts of a large group move a few times, not once per block.

Equal sets are one class and travel once. Links are between classes; components of classes give the
component of every document. Counts for the order live in a table of fixed size, which is broadcast;
the order is right at any size, a crowded table only makes it less helpful.

Null or wordless texts have an empty set and no links. A text with fewer words than an n-gram is one
n-gram. Ids may be null or repeat: a class is known by its set; the component of a class without any
id is null. Rows are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import SHARE
from ..session import delete_path, materialise, scratch_path, settings
from . import packing, repeats
from .common import free_names, light, pieces, spread

SKETCH_BITS = 20
SLICES = 64
# bits of the table that keeps texts at home; a crowded table lets more of them move
FILTER_BITS = 23
CHUNK_DOCS = 2_000
# a key's bits that are sent besides its bucket
KEY_BITS = 40
BUCKET_KEYS = 1_000_000
# n-grams that two similar sets share among their first ones, where they have so many
SHARED = 4
# Elements of a block at a meeting place: an even share of all, within these bounds.
BLOCK_TOKENS = (20_000, 500_000)
# blocks of a place that meet pair by pair at once
WIDE = 16
CELL = ["text_key", "set_key", "block", "place", "low", "high"]
TOKEN_BITS = np.uint64(56)
LOW = np.uint64((1 << 56) - 1)
# else the shuffles of a stored step stay until the driver happens to collect its garbage
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of all runs of `size` words; fewer words are one run; no words, none."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(size, len(words))
    hashes = packing.window_hashes(packing.word_hashes(words), width)
    # a short text is never equal to a run of full size
    return np.unique((hashes + np.uint64(size - width)) & LOW)


def required(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of these sizes with `100 * overlap >= percent * union`."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """One of so many first elements is shared with any set that is similar enough."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Counts of n-grams over all documents by the top bits of their hashes, as classes from 0 to 255.

    Tasks add up tables of fixed size; slices of them are added up by another set of tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for part in pieces(batches, 0):
            for text in part.column(0).to_pylist():
                cells = (shingles(text, size) >> (TOKEN_BITS - np.uint64(SKETCH_BITS))).astype(np.int64)
                np.add.at(total, cells, 1)
        cut = np.split(total.astype("<i8"), SLICES)
        blobs = [zlib.compress(c.tobytes(), 1) if c.any() else None for c in cut]
        at = [i for i, b in enumerate(blobs) if b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, type=pa.int32()), pa.array([blobs[i] for i in at], type=pa.binary())], names=["slice", "counts"]
        )

    def add(table):
        parts = [np.frombuffer(zlib.decompress(b), dtype="<i8") for b in table.column("counts").to_pylist()]
        total = np.sum(parts, axis=0)
        classes = np.minimum(np.floor(4 * np.log2(total + 1.0)), 255).astype(np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([classes.tobytes()], type=pa.binary())})

    kind = "slice int, counts binary"
    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(light(count), kind)
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.uint8)
    # SLICES rows, together 1 << SKETCH_BITS bytes whatever the data is
    for row in counted.groupBy("slice").applyInArrow(add, kind).collect():
        out[row["slice"]] = np.frombuffer(row["counts"], dtype=np.uint8)
    return out.reshape(-1)


def in_order(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order: class of the count in the upper bits, hash below."""
    cells = (hashes >> (TOKEN_BITS - np.uint64(SKETCH_BITS))).astype(np.int64)
    return np.sort(classes[cells].astype(np.uint64) << TOKEN_BITS | hashes)


def keys_of(ordered: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys at which a set in the global order meets every set that is similar enough, and how many it must share.

    Sizes of such two differ by less than the width of a class, so their classes are equal or next to
    each other, and both have keys for the larger one. For the class above its own a set is the
    smaller of the two: what it must share is more, and the n-grams to look at are fewer. Of the
    n-grams that two similar sets share, the first few all lie among the first of each when these
    are as many more; `needed` says how many that is in a class. The last bit of a key is its class's,
    by which the two classes of a set are told apart; the second result packs the needs of both.
    """
    n = len(ordered)
    if not n:
        return np.empty(0, dtype=np.int64), 0
    width = math.log(100 / percent) + 1e-9
    size = math.floor(math.log(n) / width)

    def needed(name: int) -> int:
        least = max(math.ceil(math.exp(name * width) - 1e-6), 1)
        return max(1, min(SHARED, -(-percent * least // 100)))

    above = max(math.ceil(math.exp((size + 1) * width) - 1e-6), n)
    fewer = n - required(n, above, percent) + needed(size + 1)
    parts = []
    for name, many in ((size, prefix_length(n, percent) - 1 + needed(size)), (size + 1, fewer if required(n, above, percent) <= n else 0)):
        hashed = packing.mix(ordered[:many] ^ packing.mix(np.array([name + 1], dtype=np.uint64)))
        parts.append(hashed & ~np.uint64(1) | np.uint64(name & 1))
    return np.unique(np.concatenate(parts)).astype(np.int64), size & 1 | needed(size) << 1 | needed(size + 1) << 9


class Trie:
    """Ordered sets as paths; runs without a branch are one edge."""

    def __init__(self, sets: list[np.ndarray]):
        """`sets` are distinct and sorted as sequences."""
        self.sets = sets
        self.root = self._node(0, len(sets), 0, [self._shared(a, b) for a, b in zip(sets, sets[1:])])

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(differ.argmax()) if differ.any() else n

    def _node(self, begin: int, end: int, depth: int, shared: list[int]) -> list:
        """`[edge, depth at its end, least length, greatest length, set that ends here or -1, children]`, without recursion."""
        top: list = []
        work = [(begin, end, depth, top)]
        while work:
            begin, end, depth, out = work.pop()
            first = self.sets[begin]
            down = len(first) if end - begin == 1 else min(shared[begin : end - 1])
            lengths = [len(s) for s in self.sets[begin:end]]
            ends = begin if len(first) == down else -1
            children: list = []
            out.append([first[depth:down], down, min(lengths), max(lengths), ends, children])
            if end - begin > 1:
                start = begin + (ends >= 0)
                for i in range(start, end):
                    if i == end - 1 or shared[i] == down:
                        work.append((start, i + 1, down, children))
                        start = i + 1
        return top[0]

    def similar(self, query: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Sets similar enough to `query`, by walking the tree; `skip(set)` is asked before the last step."""
        n = len(query)
        least, most = -(-percent * n // 100), n * 100 // percent
        work = [(self.root, 0)]
        while work:
            (edge, depth, shortest, longest, ends, children), overlap = work.pop()
            if longest < least or shortest > most or (ends >= 0 and not children and skip(ends)):
                continue
            need = required(n, max(shortest, least), percent)
            done = depth - len(edge)
            # at first as many elements as may differ and some more: mostly they tell
            first = longest - need + 24
            for part in (edge[:first], edge[first:]):
                if len(part):
                    at = np.searchsorted(query, part)
                    found = query[np.minimum(at, n - 1)] == part
                    overlap += int(np.count_nonzero(found))
                    done += len(part)
                    if overlap + min(n - int(at[-1]) - int(found[-1]), longest - done) < need:
                        break
            else:
                if ends >= 0 and overlap >= required(n, depth, percent) and not skip(ends):
                    yield ends
                work.extend((child, overlap) for child in children)


class Forest:
    """Which sets are connected so far."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def links_of(sets: list[np.ndarray], blocks: list[int], percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect all similar sets of one meeting place, or `every` one; of two blocks only pairs between them."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    ordered = [sets[i] for i in order]
    mine = [blocks[i] for i in order]
    across = len(set(mine)) > 1
    trie, forest, links = Trie(ordered), Forest(len(sets)), []
    for i, query in enumerate(ordered):
        if across and mine[i] != min(mine):
            continue
        # of one block every pair is looked at from both sides, the second time both are connected or never will be
        skip = lambda j: (across and mine[j] == mine[i]) or (not across and j <= i) or (not every and forest.find(j) == forest.find(i))
        for j in trie.similar(query, percent, skip):
            forest.join(i, j)
            links.append((order[i], order[j]))
    return links


def _heads(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """`(id, text_key, n, set_key, head, need)` of every document: size and key of its set, and the keys to meet others at.

    A task gives the keys of equal sets once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in pieces(batches, 1):
            keys, heads, sizes, needs = [], [], [], []
            for text in part.column(1).to_pylist():
                ordered = in_order(shingles(text, size), classes)
                key = hashlib.blake2b(ordered.tobytes(), digest_size=16).digest() if len(ordered) else None
                head, need = (None, 0) if key is None or key in seen else keys_of(ordered, percent)
                heads.append(head)
                needs.append(need)
                keys.append(key)
                sizes.append(len(ordered))
                if key is not None:
                    seen.add(key)
            columns = [
                part.column(0),
                part.column(2),
                pa.array(sizes, type=pa.int64()),
                pa.array(keys, type=pa.binary()),
                pa.array(heads, type=pa.list_(pa.int64())),
                pa.array(needs, type=pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "n", "set_key", "head", "need"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(light(head), f"id {kind}, text_key binary, n bigint, set_key binary, head array<bigint>, need int")


def units_of(keys: np.ndarray, docs: np.ndarray) -> pa.Table:
    """Keys and units of a chunk, as `shared_keys` returns them, from pairs of key and document: each once, the same keys side by side.

    The unit is the smallest document met at any key, each key having the smallest of its documents.
    """
    if not len(keys):
        return pa.table([pa.array([], type=t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())], names=["token", "unit", "several", "doc"])
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    smallest = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.append(begin, len(keys))))
    names, which = np.unique(docs, return_inverse=True)
    unit = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(unit, which, smallest)
    order = np.lexsort((unit[which], keys))
    token, of = keys[order], unit[which][order]
    at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (of[1:] != of[:-1])))
    several = np.diff(np.append(at, len(token))) > 1
    none = len(names)
    columns = [
        pa.array([*token[at].tolist(), *[None] * none], type=pa.int64()),
        pa.array(np.concatenate((of[at], unit))),
        pa.array([*several.tolist(), *[None] * none], type=pa.bool_()),
        pa.array([*[None] * len(at), *names.tolist()], type=pa.int64()),
    ]
    return pa.table(columns, names=["token", "unit", "several", "doc"])


def in_chunks(heads: DataFrame) -> DataFrame:
    """`(doc, head, need, chunk)`: documents with keys, dealt by their smallest key, so that near copies mostly share a chunk.

    Where very many have one smallest key, its documents are dealt over chunks; fewer than SHARE keys are such.
    """
    rows = heads.filter("head is not null").select(F.xxhash64("set_key").alias("doc"), "head", "need", F.element_at("head", 1).alias("least"))
    docs = rows.count()
    chunks = max(repeats.LEAST_CHUNKS, -(-docs // CHUNK_DOCS))
    each = max(CHUNK_DOCS, docs // SHARE)
    crowded = rows.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") > each)
    crowded = crowded.select("least", F.ceil(F.col("n") / each).alias("parts"))
    dealt = rows.join(F.broadcast(crowded), "least", "left").withColumn("part", F.pmod("doc", F.coalesce("parts", F.lit(1))))
    return dealt.select("doc", "head", "need", spread(chunks, "least", "part").alias("chunk"))


def shared_keys(heads: DataFrame) -> DataFrame:
    """`(token, unit, several, doc)`: keys that two sets have, where there are as many as needed, with the unit of these sets.

    A unit is documents of one chunk with a shared key; `several` tells that two of them have the key.
    Rows without a token name the documents, by the hashes of their sets, of every unit.

    Chunks of documents send their distinct keys, packed, to buckets; a bucket answers with a bit for
    each. The documents of a chunk move once, and their keys a few bytes each.
    """
    keys = heads.agg(F.sum(F.size("head"))).first()[0]
    bits = packing.bucket_bits(keys or 0, BUCKET_KEYS)
    by_chunk = in_chunks(heads).groupBy("chunk")

    def keys_in(table):
        heads = table.column("head").combine_chunks()
        keys = heads.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        counts = pc.list_value_length(heads).to_numpy(zero_copy_only=False)
        docs = np.repeat(table.column("doc").to_numpy(), counts)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        return keys[fresh], docs[fresh]

    def send(key, table):
        keys, _ = keys_in(table)
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        often = np.diff(np.append(at, len(keys))) > 1
        distinct = keys[at]
        cuts = packing.cuts_by_bucket(distinct, bits)
        out = [
            (2, b, key[0].as_py(), int(j - i), packing.pack(distinct[i:j], bits, KEY_BITS), packing.flags(often[i:j]), b"")
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:]))
            if i < j
        ]
        return repeats.blob_rows(out, repeats.BLOB_SCHEMA)

    def receive(key, table, answers):
        keys, docs = keys_in(table)
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        shared = np.zeros(int(first.sum()), dtype=bool)
        cuts = packing.cuts_by_bucket(keys[first], bits)
        for b, answer in repeats.answers_of(answers, 2).items():
            shared[cuts[b] : cuts[b + 1]] = answer
        here = shared[np.cumsum(first) - 1] if len(keys) else np.zeros(0, dtype=bool)
        keys, docs = keys[here], docs[here]
        # keys of each document and class, and how many it needs
        names, which = np.unique(docs, return_inverse=True)
        everyone, needs = table.column("doc").to_numpy(), table.column("need").to_numpy()
        order = np.argsort(everyone, kind="stable")
        need = needs[order][np.searchsorted(everyone[order], names)]
        group = which * 2 + (keys & np.uint64(1)).astype(np.int64)
        there = np.bincount(group, minlength=2 * len(names))
        wanted = np.empty(2 * len(names), dtype=np.int64)
        own = need & 1
        wanted[np.arange(len(names)) * 2 + own] = need >> 1 & 255
        wanted[np.arange(len(names)) * 2 + 1 - own] = need >> 9
        here = there[group] >= wanted[group]
        return units_of(keys[here].astype(np.int64), docs[here].astype(np.int64))

    blobs = by_chunk.applyInArrow(send, repeats.BLOBS)
    answers = blobs.groupBy("bucket").applyInArrow(repeats.count_blobs, repeats.ANSWERS)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(receive, "token bigint, unit bigint, several boolean, doc bigint")


def places(met: DataFrame, classes: DataFrame) -> DataFrame:
    """`(set_key, place)`: where every class is compared; without a partner, nowhere. `met` is as `shared_keys` has it.

    Every step groups by one key with sums made before rows move, and joins back with one small row per
    key. Each is stored by itself, so that the shuffles of one are gone when the next one begins.
    """
    spark = classes.sparkSession
    members = met.filter("token is null").select("unit", "doc")
    keys = met.filter("token is not null").select("token", "unit", "several")
    # a key may have lost all documents but one
    partners = F.min("unit").alias("least"), F.max("unit").alias("most"), F.max("several").alias("several")
    met_by = F.col("several") | (F.col("least") < F.col("most"))
    first = keys.groupBy("token").agg(*partners).filter(met_by).select("token", F.col("least").alias("place"))
    label = keys.select("token", "unit").join(first, "token").groupBy("unit").agg(F.min("place").alias("label"))
    label = materialise(label, scratch_path(spark, "ngram-labels"))
    moved = keys.join(label, "unit").groupBy("token").agg(F.min("label").alias("place"), *partners).filter(met_by).select("token", "place")
    moved = materialise(moved, scratch_path(spark, "ngram-moved"))
    found = keys.select("token", "unit").join(moved, "token").select("unit", "place").distinct()
    named = classes.select("set_key", F.xxhash64("set_key").alias("doc"))
    return named.join(members, "doc").join(found, "unit").select("set_key", "place")


def meetings_of(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, order: np.ndarray
) -> tuple[DataFrame, DataFrame]:
    """`(id, text_key, n, set_key)` of every document, and `(set_key, text_key, n, place)` of the classes that meet others.

    The keys of documents are removed when it is known which are shared, these when places are known.
    """
    spark = docs.sparkSession
    heads_at, met_at = scratch_path(spark, "ngram-heads"), scratch_path(spark, "ngram-postings")
    heads = materialise(_heads(docs, id_col, text_col, size, percent, order), heads_at)
    met = materialise(shared_keys(heads), met_at)
    known = materialise(heads.drop("head", "need"), scratch_path(spark, "ngram-sets"))
    delete_path(spark, heads_at)
    some = known.filter("n > 0").groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"))
    classes = materialise(some, scratch_path(spark, "ngram-classes"))
    meetings = materialise(places(met, classes).join(classes, "set_key"), scratch_path(spark, "ngram-places"))
    delete_path(spark, met_at)
    return known, meetings


def _bit_of(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") & ((1 << FILTER_BITS) - 1)


def key_filter(wanted: DataFrame) -> np.ndarray:
    """A table of bits for the text keys in `wanted`; of fixed size, so it may be sent to all tasks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[[_bit_of(k) for k in batch.column(0).to_pylist()]] = True
        cut = [(i, np.packbits(x).tobytes()) for i, x in enumerate(np.split(bits, SLICES)) if x.any()]
        names = pa.array([i for i, _ in cut], type=pa.int32())
        yield pa.RecordBatch.from_arrays([names, pa.array([zlib.compress(x, 1) for _, x in cut], type=pa.binary())], names=["slice", "bits"])

    def either(table):
        parts = [np.frombuffer(zlib.decompress(b), dtype=np.uint8) for b in table.column("bits").to_pylist()]
        merged = zlib.compress(np.bitwise_or.reduce(parts).tobytes(), 1)
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([merged], type=pa.binary())})

    kind = "slice int, bits binary"
    out = np.zeros((SLICES, (1 << FILTER_BITS) // SLICES // 8), dtype=np.uint8)
    for row in wanted.select("text_key").mapInArrow(light(mark), kind).groupBy("slice").applyInArrow(either, kind).collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return out.reshape(-1)


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """`(text, ...)`: the rows of `wanted`, which is unique by `text_key`, with their texts; every text once."""
    text = F.col(f"`{text_col}`").cast("string")
    bits = key_filter(wanted)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_bit_of(k) if k else None for k in batch.column(0).to_pylist()]
            keep = [p is not None and bool(bits[p >> 3] >> (7 - (p & 7)) & 1) for p in places]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    keyed = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    likely = keyed.mapInArrow(light(some), "text_key binary, text string")
    return likely.groupBy("text_key").agg(F.first("text").alias("text")).join(wanted, "text_key").drop("text_key")


def class_links(
    docs: DataFrame, meetings: DataFrame, text_col: str, size: int, percent: int, order: np.ndarray, every: bool = False
) -> DataFrame:
    """`(src, dst)`: links between classes, by set key, enough to connect all that are similar.

    With `every`, all similar pairs, in either order and once or more per place where they meet.
    """
    spark = docs.sparkSession
    share = (meetings.agg(F.sum("n").alias("n")).first()["n"] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = min(max(share, BLOCK_TOKENS[0]), BLOCK_TOKENS[1])
    blocks = F.ceil(F.col("total") / F.lit(each)).cast("int")
    sizes = meetings.groupBy("place").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    sizes = sizes.filter("members > 1").select("place", "total", blocks.alias("blocks"))
    sizes = materialise(sizes, scratch_path(spark, "ngram-sizes"))
    dealt = meetings.join(sizes, "place").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    if every or sizes.filter(F.col("blocks") > WIDE).isEmpty():
        return _compared(docs, _all_cells(dealt, 0), text_col, size, percent, order, every)
    wide = dealt.filter(F.col("blocks") > WIDE)
    cells = _all_cells(dealt.filter(F.col("blocks") <= WIDE), 0).unionByName(_first_cells(wide))
    links = materialise(_compared(docs, cells, text_col, size, percent, order), scratch_path(spark, "ngram-links"))
    rest = _rest_cells(wide, links, each)
    return links.unionByName(_compared(docs, rest, text_col, size, percent, order))


def _all_cells(dealt: DataFrame, begin: int) -> DataFrame:
    """Cells in which all blocks from `begin` on of a place meet pair by pair; the first of all meets itself as well."""
    partner = F.explode(F.sequence(F.lit(begin), F.col("blocks") - 1))
    cells = dealt.withColumn("partner", partner).filter((F.col("partner") != F.col("block")) | F.lit(begin == 0))
    return cells.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner")).select(*CELL)


def _first_cells(dealt: DataFrame) -> DataFrame:
    """Cells of the first block of a place and each other one, in which everything is compared."""
    mine = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1), F.col("blocks") - 1))
    cells = dealt.withColumn("high", F.explode(mine)).withColumn("low", F.lit(0))
    return cells.withColumn("block", F.lit(0)).select(*CELL)


def _rest_cells(dealt: DataFrame, links: DataFrame, each: int) -> DataFrame:
    """Cells for what `_first_cells` left: sets outside the largest component of a place against all blocks but the first and their own.

    Where these sets are most of a place, all its blocks but the first meet pair by pair.
    """
    spark = dealt.sparkSession
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
    roots = connected_components(ends, links).select(F.col("id").alias("set_key"), F.col("component").alias("root"))
    named = dealt.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    named = materialise(named, scratch_path(spark, "ngram-rooted"))
    weights = named.groupBy("place", "root").agg(F.sum("n").alias("held"))
    largest = weights.groupBy("place").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.max("held").alias("held"))
    named = named.join(largest, "place").withColumn("left", F.col("total") - F.col("held"))
    mostly = F.col("left") * 2 > F.col("total")
    pairs = _all_cells(named.filter(mostly & (F.col("block") > 0)), 1)
    some = named.filter(~mostly & (F.col("left") > 0)).withColumn("parts", F.ceil(F.col("left") / F.lit(each)).cast("int"))
    part = F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("parts")).cast("int")
    outside = some.filter(F.col("root") != F.col("main")).withColumn("low", part)
    outside = outside.withColumn("high", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).filter(F.col("high") != F.col("block"))
    inside = some.filter(F.col("block") > 0).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.withColumn("high", F.col("block"))
    outside, inside = (x.withColumn("block", F.lit(i)).select(*CELL) for i, x in enumerate((outside, inside)))
    return pairs.unionByName(outside).unionByName(inside)


def _compared(
    docs: DataFrame, cells: DataFrame, text_col: str, size: int, percent: int, order: np.ndarray, every: bool = False
) -> DataFrame:
    """`(src, dst)`: links within `cells`, to which the texts travel."""
    wanted = cells.groupBy("text_key", "set_key").agg(F.collect_list(F.struct("place", "block", "low", "high")).alias("cells"))
    wanted = materialise(wanted, scratch_path(docs.sparkSession, "ngram-cells"))
    needed = texts_of(docs, wanted, text_col)
    rows = needed.select("set_key", "text", F.explode("cells").alias("c")).select("set_key", "text", "c.*")

    def join(table):
        keys = table.column("set_key").to_pylist()
        found = [in_order(shingles(t, size), order) for t in table.column("text").to_pylist()]
        links = links_of(found, table.column("block").to_pylist(), percent, every)
        ends = [[keys[link[side]] for link in links] for side in (0, 1)]
        return pa.table({"src": pa.array(ends[0], type=pa.binary()), "dst": pa.array(ends[1], type=pa.binary())})

    return rows.groupBy("place", "low", "high").applyInArrow(join, "src binary, dst binary")


def _members(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """`(id, text_key, n, set_key, root, component)` of every document; stored steps lie behind it."""
    spark = docs.sparkSession
    with settings(spark, SHUFFLES_GO):
        order = sketch(docs, text_col, size)
        known, meetings = meetings_of(docs, id_col, text_col, size, percent, order)
        links = materialise(class_links(docs, meetings, text_col, size, percent, order), scratch_path(spark, "ngram-links"))
        ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
        roots = connected_components(ends, links).select(F.col("id").alias("set_key"), F.col("component").alias("root"))
    members = known.join(roots, "set_key", "left")
    members = members.withColumn("root", F.coalesce("root", "set_key"))
    smallest = members.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return members.join(smallest, "root", "left").withColumn("component", alone).drop("least")


def similar_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """`(src, dst, src_id, dst_id)`: every pair of similar classes once, by set key, with the smallest id of each.

    A class is all documents with one set of n-grams; texts without a word are in none.
    """
    spark = docs.sparkSession
    with settings(spark, SHUFFLES_GO):
        order = sketch(docs, text_col, size)
        known, meetings = meetings_of(docs, id_col, text_col, size, percent, order)
        links = class_links(docs, meetings, text_col, size, percent, order, every=True)
    pairs = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    least = known.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("least"))
    for side in ("src", "dst"):
        pairs = pairs.join(least.select(F.col("set_key").alias(side), F.col("least").alias(f"{side}_id")), side)
    return pairs.select("src", "dst", "src_id", "dst_id")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """`(id_col, n_shingles, component_id)`: the smallest id that links reach.

    Two documents link when 100 times their shared n-grams of `size` words are `percent` times all
    they have or more.
    """
    found = _members(docs, id_col, text_col, size, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` with one document of each group: the one with the smallest id.

    Rows with equal id and text are one document; other rows of one id stay or go together. Of a group
    without any id one text stays; texts without a word are groups of their own.
    """
    spark = docs.sparkSession
    members = _members(docs, id_col, text_col, size, percent)
    with settings(spark, SHUFFLES_GO):
        found = materialise(members, scratch_path(spark, "ngram-members"))
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    kept, mine, other = free_names(docs.columns, 3)
    chosen = found.filter("id = component").select(F.col("id").alias(kept)).distinct()
    # dealt by id for the join, which is enough to meet repeated rows as well
    named = docs.filter(key.isNotNull()).join(chosen, key == F.col(kept), "left_semi").dropDuplicates([id_col, text_col])
    nameless = found.filter("id is null and component is null")
    of_groups = nameless.groupBy(F.coalesce("root", "text_key").alias("root")).agg(F.min("text_key").alias(other)).select(other)
    keyed = docs.filter(key.isNull()).withColumn(mine, F.unhex(F.md5(text)))
    some = keyed.join(of_groups, F.col(mine).eqNullSafe(F.col(other)), "left_semi").dropDuplicates([mine]).drop(mine)
    return named.unionByName(some)
