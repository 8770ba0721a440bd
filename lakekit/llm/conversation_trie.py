"""Prefix trie over conversations, built as double arrays.

A conversation is the sequence of its turns (role, text) by turn number, null first, turns of equal
number by the MD5 of role and text. Every distinct sequence of first turns is a node; the
conversations that start with it are its members, the root has all of them.

Equal sequences are one path with a weight. Prefixes that more than `PATHS` paths (or a millionth of
all turns, if that is more) go on from are the shared upper nodes; there are at most a million of
them. Below them the trie falls into shards, one for each next turn, which belong to one task each:
there the turns get dense ids and the paths are packed into BASE and CHECK arrays, are walked through
them, and the nodes' aggregates are added up from the leaves. What the shards hand up is grouped by
upper node before it moves, and the small tree of upper nodes is added up once.

The SHA-256 over the ids of all conversations that end at a node is one sequence by its definition; ids
are strung together in blocks of 4,096 numbers first, and one task reads those strings in order.

Null role and text are empty; rows without conversation id belong to none; repeated rows are turns of
their own; other columns are not looked at. An empty table has no nodes, not even a root. A
conversation is one row, as a document is: 24 bytes for each of its turns, texts do not move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path

PATHS = 5_000
# Shared upper nodes are at most this many: each has that share of all turns below it.
UPPER = 1_000_000
# Ids are gathered by blocks of 2^BLOCK consecutive numbers.
BLOCK = 12
# Free slots tried for a node before its children go behind all others; they change the arrays' length only.
WINDOW, TRIES = 1 << 12, 32
TOP = hashlib.md5(b"", usedforsecurity=False).digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`(conv_id, turns)`: for every conversation its turns in order, as key and bytes of the text."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("size")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def _chain(keys: list[bytes]) -> list[bytes]:
    """Names of the nodes on a path, without the root: each is the digest of its parent and its turn."""
    out, node = [], TOP
    for key in keys:
        node = hashlib.md5(node + key, usedforsecurity=False).digest()
        out.append(node)
    return out


def _keys(column: pa.Array) -> list[list[bytes]]:
    """Keys of the turns of every row of an array of turns."""
    return [[t["key"] for t in turns] for turns in column.to_pylist()]


def _paths(sequenced: DataFrame, folder: str) -> DataFrame:
    """`(path, turns, n, conv_id, ends)`: distinct sequences with their conversations' number, smallest id and digest of ids."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [(_chain(keys) or [TOP])[-1] for keys in _keys(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *batch.columns], names=["path", "conv_id", "turns"])

    kind = sequenced.schema["turns"].dataType.simpleString()
    named = materialise(sequenced.mapInArrow(name, f"path binary, conv_id bigint, turns {kind}"), f"{folder}/named")
    block = F.shiftright("conv_id", BLOCK).alias("block")
    strung = named.groupBy("path", block).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    strung = strung.select("path", "block", F.size("ids").alias("n"), F.element_at("ids", 1).alias("conv_id"), F.array_join("ids", ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, least, state = None, 0, None, None
        names = ["path", "n", "conv_id", "ends"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            done = []
            for path, n, conv, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if path == now:
                    state.update(b"," + ids.encode())
                    total += n
                    continue
                if now is not None:
                    done.append((now, total, least, state.hexdigest()))
                now, total, least, state = path, n, conv, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((now, total, least, state.hexdigest()), kinds)], names=names)

    ends = strung.repartition("path").sortWithinPartitions("path", "block").select("path", "n", "conv_id", "ids")
    ends = ends.mapInArrow(digest, "path binary, n bigint, conv_id bigint, ends string")
    turns = named.groupBy("path").agg(F.first("turns").alias("turns"))
    return materialise(turns.join(ends, "path"), f"{folder}/paths")


UPPER_COLUMNS = "node binary, parent binary, depth bigint, size bigint"


def _upper(paths: DataFrame, limit: int) -> DataFrame:
    """Prefixes of more than `limit` paths, without the root."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turns in batch.column(0).to_pylist():
                nodes = _chain([t["key"] for t in turns])
                if nodes:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(nodes, pa.binary()),
                            pa.array([TOP, *nodes[:-1]], pa.binary()),
                            pa.array(range(1, len(nodes) + 1), pa.int64()),
                            pa.array([t["size"] for t in turns], pa.int64()),
                        ],
                        names=["node", "parent", "depth", "size"],
                    )

    found = paths.select("turns").mapInArrow(prefixes, UPPER_COLUMNS).groupBy("node", "parent", "depth", "size")
    return found.agg(F.count("*").alias("paths")).filter(F.col("paths") > limit).drop("paths")


class DoubleArray:
    """Trie over sequences of dense codes from 1: the child of slot s by code c is t = BASE[s] + c if CHECK[t] = s."""

    def __init__(self, sequences: list[list[int]]):
        self.base = np.zeros(64, dtype=np.int64)
        self.check = np.full(64, -1, dtype=np.int64)
        self.check[0] = 0
        # the first slot that may be free, and the first behind all used ones
        self.free = self.end = 1
        ordered = sorted(sequences)
        todo = [(0, 0, len(ordered), 0)]
        while todo:
            slot, begin, end, depth = todo.pop()
            while begin < end and len(ordered[begin]) == depth:
                begin += 1
            if begin == end:
                continue
            codes, starts = [], []
            for at in range(begin, end):
                code = ordered[at][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    starts.append(at)
            base = self._place(codes)
            self.base[slot] = base
            for code, first, last in zip(codes, starts, [*starts[1:], end]):
                self.check[base + code] = slot
                todo.append((base + code, first, last, depth + 1))

    def _place(self, codes: list[int]) -> int:
        """A base at which all slots of `codes` are free: one of the first free slots, else behind all used ones."""
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        offsets = np.array(codes) - codes[0]
        near = self.check[self.free : self.free + WINDOW]
        for spot in (self.free + np.flatnonzero(near < 0)[:TRIES]).tolist():
            self._reach(spot + int(offsets[-1]))
            if (self.check[spot + offsets] < 0).all():
                break
        else:
            spot = max(self.free, self.end)
            self._reach(spot + int(offsets[-1]))
        self.end = max(self.end, spot + int(offsets[-1]) + 1)
        return spot - codes[0]

    def _reach(self, slot: int) -> None:
        if slot >= len(self.check):
            more = max(slot + 1 - len(self.check), len(self.check))
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))

    def walk(self, codes: list[int]) -> list[int]:
        """Slots below the root on the way of a sequence; it ends where the trie does."""
        out, slot = [], 0
        for code in codes:
            t = int(self.base[slot]) + code
            if not 0 < t < len(self.check) or self.check[t] != slot:
                break
            out.append(t)
            slot = t
        return out


NODE_COLUMNS = (
    "above binary, ends_above boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
NODE_KINDS = [pa.binary(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
NAMES = [c.split(" ")[0] for c in NODE_COLUMNS.split(", ")]


def _added_up(parent: np.ndarray, depth: np.ndarray, n: np.ndarray, size: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
    """Adds leaves and savings of all nodes to their parents, from the deepest up; `parent` is -1 at the top."""
    leaves += children == 0
    saved += (n - 1) * size
    order = np.argsort(-depth, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        group = group[parent[group] >= 0]
        np.add.at(leaves, parent[group], leaves[group])
        np.add.at(saved, parent[group], saved[group])


def _shard_nodes(rows: list[tuple]) -> pa.RecordBatch:
    """Nodes of some whole shards; rows are (shard, level, above, turns, n, conv_id, ends)."""
    symbols = sorted({r[0] for r in rows}) + sorted({t["key"] for r in rows for t in r[3][r[1] :]})
    shards = {r[0]: 0 for r in rows}
    code = {}
    for i, symbol in enumerate(symbols, 1):
        code[(i <= len(shards), symbol)] = i
    coded = [[code[True, r[0]], *[code[False, t["key"]] for t in r[3][r[1] :]]] for r in rows]
    trie = DoubleArray(coded)
    slots = len(trie.check)
    n, size, depth = (np.zeros(slots, dtype=np.int64) for _ in range(3))
    least = np.full(slots, np.iinfo(np.int64).max)
    above: dict[int, bytes] = {}
    ends: dict[int, str] = {}
    for row, codes in zip(rows, coded):
        way = trie.walk(codes)
        n[way] += row[4]
        least[way] = np.minimum(least[way], row[5])
        depth[way] = np.arange(row[1], row[1] + len(way))
        size[way] = [t["size"] for t in row[3][row[1] - 1 :]]
        above[way[0]] = row[2]
        ends[way[-1]] = row[6]
    used = np.flatnonzero(n)
    place = np.zeros(slots, dtype=np.int64)
    place[used] = np.arange(len(used))
    parent = np.where(trie.check[used] > 0, place[trie.check[used]], -1)
    children = np.bincount(parent[parent >= 0], minlength=len(used))
    leaves, saved = np.zeros(len(used), dtype=np.int64), np.zeros(len(used), dtype=np.int64)
    _added_up(parent, depth[used], n[used], size[used], children, leaves, saved)
    ids = least[used]
    parents = pa.array(ids[np.maximum(parent, 0)], mask=parent < 0)
    columns = [
        [above.get(s) for s in used.tolist()], [False] * len(used), ids, depth[used], parents, n[used], children, leaves, saved,
        [ends.get(s, NO_ENDS) for s in used.tolist()],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, NODE_KINDS)], names=NAMES)


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    """Paths that end at an upper node, handed up to it."""
    columns = zip(*[(path, True, conv, 0, None, n, 0, 0, 0, ends) for path, n, conv, ends in rows])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, NODE_KINDS)], names=NAMES)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their shard; a trie is packed when enough whole shards are there."""
    rows: list[tuple] = []
    for batch in batches:
        for shard, level, above, turns, path, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if level > len(turns):
                yield _ended([(path, n, conv, ends)])
                continue
            if len(rows) >= PATHS and rows[-1][0] != shard:
                yield _shard_nodes(rows)
                rows = []
            rows.append((shard, level, above, turns, n, conv, ends))
    if rows:
        yield _shard_nodes(rows)


def _upper_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of upper nodes, added up in one go; it has `UPPER` rows at most."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: r["depth"])
    at = {r["node"]: i for i, r in enumerate(rows)}
    parent = np.array([at[r["parent"]] if r["depth"] else -1 for r in rows])
    number = lambda c: np.array([r[c] for r in rows], dtype=np.int64)
    n, children, leaves, saved, depth = (number(c) for c in ("n", "children", "leaves", "saved", "depth"))
    least = [r["least"] for r in rows]
    for i in range(len(rows) - 1, 0, -1):
        up = parent[i]
        n[up] += n[i]
        children[up] += 1
        least[up] = min(x for x in (least[up], least[i]) if x is not None)
    _added_up(parent, depth, n, number("size"), children, leaves, saved)
    parents = [least[p] if p >= 0 else None for p in parent]
    columns = [[r["node"] for r in rows], [False] * len(rows), least, depth, parents, n, children, leaves, saved, [r["ends"] or NO_ENDS for r in rows]]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, NODE_KINDS)], names=NAMES)


def nodes(sequenced: DataFrame, most_paths: int = PATHS) -> DataFrame:
    """One row per node of `(conv_id, turns)`, every conversation once: `conv_id` (smallest member),
    `depth`, `parent_conv_id` (null at the root), `n_convs`, `n_children`, `n_leaves` (childless nodes
    in the subtree, the node included), `saved_tokens` (over the subtree, members but one times bytes of
    the node's text) and `ends_sha256` (of the sorted ids that end here, joined by commas)."""
    spark = sequenced.sparkSession
    folder = scratch_path(spark, "trie")
    paths = _paths(sequenced, folder)
    turns = paths.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("n")).first()["n"]
    upper = materialise(_upper(paths, max(most_paths, turns // UPPER)), f"{folder}/upper")
    known = spark.sparkContext.broadcast({r["node"] for r in upper.select("node").collect()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, level, above = [], [], []
            for keys in _keys(batch.column(0)):
                way = [TOP, *_chain(keys)]
                deep = 1
                while deep < len(way) and way[deep] in known.value:
                    deep += 1
                shard.append(way[min(deep, len(way) - 1)])
                level.append(deep)
                above.append(way[deep - 1])
            columns = [pa.array(shard, pa.binary()), pa.array(level, pa.int32()), pa.array(above, pa.binary()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "level", "above", "turns", "path", "n", "conv_id", "ends"])

    kind = paths.schema["turns"].dataType.simpleString()
    placed = paths.select("turns", "path", "n", "conv_id", "ends").mapInArrow(
        place, f"shard binary, level int, above binary, turns {kind}, path binary, n bigint, conv_id bigint, ends string"
    )
    found = placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_tries, NODE_COLUMNS)
    found = materialise(found, scratch_path(spark, "nodes"))

    handed = found.filter(F.col("above").isNotNull() & ~F.col("ends_above")).groupBy("above").agg(
        F.count("*").alias("children"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
    )
    ended = found.filter("ends_above").select(F.col("above"), F.col("n_convs").alias("own"), F.col("conv_id").alias("first"), F.col("ends_sha256").alias("ends"))
    top = paths.limit(1).select(F.lit(TOP).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("size"))
    tree = upper.unionByName(top).withColumnRenamed("node", "above").join(handed, "above", "left").join(ended, "above", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    tree = tree.select(
        F.col("above").alias("node"), "parent", "depth", "size", zero("children"), (zero("n") + zero("own")).alias("n"),
        F.least("least", "first").alias("least"), zero("leaves"), zero("saved"), "ends",
    )
    top_nodes = materialise(tree.repartition(1).mapInArrow(_upper_tree, NODE_COLUMNS), scratch_path(spark, "upper-nodes"))
    delete_path(spark, folder)

    columns = [c for c in NAMES if c not in ("above", "ends_above")]
    # at most UPPER rows of one digest and one id
    parents = F.broadcast(top_nodes.select("above", F.col("conv_id").alias("up")))
    below = found.filter(~F.col("ends_above")).join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return below.select(*columns).unionByName(top_nodes.select(*columns))
