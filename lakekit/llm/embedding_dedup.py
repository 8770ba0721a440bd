"""Near-duplicate vectors by a forest of random-projection trees with spill.

Every tree splits the unit vectors again and again along a random direction, at the median of a
bounded sample. Vectors near a split go to both sides, so that two similar ones are rarely parted.
Vectors meet in the leaves, where every pair of equal label is compared in double precision. Each
vector knows all its leaves: a pair that meets in several is counted in the first one only, so
numbers of links are sums over leaves, and what leaves a task is one count per vector and links
enough to connect what belongs together, never all pairs.

Equal vectors of a label are one class and are compared once. A leaf too large for one task is dealt
into blocks that meet pair by pair; nothing is left out. The trees are fitted on `SAMPLE` vectors at
most, every vector is put into all of them. Below the depth the sample can tell, splits are at the
sample's median of that direction.

Null and zero vectors and those with a null or non-finite component, and rows without a label, link
with nothing. Vectors of different length do not link. Ids may be null or repeat, every row is a
vector; the component of rows without any id is null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialise, scratch_path

SAMPLE = 8_000
TREES = 4
LEAF = 1_500
# half the width of the overlap, in standard deviations of how far a linking pair is apart along a direction
SPILL = 0.5
BLOCK_ROWS = (64, 1_024)
NODE_BITS = 48


@dataclass(frozen=True)
class Forest:
    """Directions by tree and level, and where each node splits."""

    directions: np.ndarray  # trees x levels x dimensions
    splits: list[np.ndarray]  # by tree: by node in heap order, as far as the sample told
    medians: np.ndarray  # trees x levels
    margin: float

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf codes of unit vectors; several leaves of a tree for those near a split."""
        rows_out, codes_out = [], []
        for t, (levels, splits) in enumerate(zip(self.directions, self.splits)):
            along = unit @ levels.T
            rows, nodes = np.arange(len(unit)), np.ones(len(unit), dtype=np.int64)
            for level in range(len(levels)):
                at = self._split(t, level, nodes, splits)
                place = along[rows, level] - at
                left, right = place < self.margin, place >= -self.margin
                rows = np.concatenate((rows[left], rows[right]))
                nodes = np.concatenate((2 * nodes[left], 2 * nodes[right] + 1))
            rows_out.append(rows)
            codes_out.append(nodes | np.int64(t) << np.int64(NODE_BITS))
        return np.concatenate(rows_out), np.concatenate(codes_out)

    def _split(self, tree: int, level: int, nodes: np.ndarray, splits: np.ndarray) -> np.ndarray:
        known = np.where(nodes < len(splits), splits[np.minimum(nodes, len(splits) - 1)], np.nan)
        return np.where(np.isnan(known), self.medians[tree, level], known)


def fit(sample: np.ndarray, total: int, least_cosine: float, trees: int = TREES, seed: int = 7) -> Forest:
    """A forest for `total` vectors from unit vectors of a sample."""
    dimensions = sample.shape[1] if sample.ndim == 2 and sample.size else 1
    depth = max(0, math.ceil(math.log2(max(total, 1) / LEAF)))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, dimensions))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits, medians = [], np.zeros((trees, depth))
    for t in range(trees):
        along = sample @ directions[t].T if len(sample) else np.zeros((0, depth))
        nodes = np.ones(len(sample), dtype=np.int64)
        told = min(depth, max(0, int(math.log2(max(len(sample), 1) / 16))))
        at = np.full(1 << told, np.nan)
        for level in range(depth):
            medians[t, level] = np.median(along[:, level]) if len(sample) else 0.0
            if level >= told:
                continue
            order = np.argsort(nodes, kind="stable")
            names, begins = np.unique(nodes[order], return_index=True)
            for name, mine in zip(names.tolist(), np.split(order, begins[1:])):
                if len(mine) >= 16:
                    at[name] = np.median(along[mine, level])
            here = np.where(np.isnan(at[nodes]), medians[t, level], at[nodes])
            nodes = 2 * nodes + (along[:, level] >= here)
        splits.append(at)
    apart = math.sqrt(max(2 - 2 * least_cosine, 0)) / math.sqrt(dimensions)
    return Forest(directions, splits, medians, SPILL * apart)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in doubles; by their largest component first, against overflow."""
    largest = np.abs(vectors).max(axis=1, keepdims=True) if vectors.size else np.ones((len(vectors), 1))
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def links_in(unit: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, leaves: list, here: int, least_cosine: float):
    """Counts of links by row, and links that connect all linked rows.

    Only pairs whose first common leaf is `here` count, and of two blocks only pairs between them.
    """
    linked = unit @ unit.T >= least_cosine
    np.fill_diagonal(linked, False)
    if len(set(blocks.tolist())) > 1:
        linked &= blocks[:, None] != blocks[None, :]
    earlier = sorted({c for mine in leaves for c in mine if c < here})
    if earlier:
        column = {c: k for k, c in enumerate(earlier)}
        member = np.zeros((len(leaves), len(earlier)), dtype=np.float32)
        for i, mine in enumerate(leaves):
            for c in mine:
                if c < here:
                    member[i, column[c]] = 1
        linked &= member @ member.T == 0
    counts = linked @ sizes
    label = np.arange(len(unit))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(unit)).min(axis=1, initial=len(unit)))
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    rows = np.flatnonzero(label != np.arange(len(unit)))
    return counts, rows, label[rows]


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """`(id, vec, cls)`: the vector as bytes of doubles and the key of its class; null for those that link with nothing."""
    values = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col(f"`{label_col}`").isNotNull() & values.isNotNull() & finite & F.exists(values, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    clean = F.when(usable, F.transform(values, lambda x: x + F.lit(0.0)))
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.size(values).alias("dimensions"),
        clean.alias("vec"),
    )
    key = F.md5(F.concat_ws("|", F.col("label"), F.array_join(F.col("vec").cast("array<string>"), ",")).cast("binary"))
    return rows.withColumn("cls", F.when(F.col("vec").isNotNull(), F.unhex(key)))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least_cosine: float = 0.93,
) -> DataFrame:
    """`(id_col, n_links, component_id, kept)` of every row."""
    spark = vectors.sparkSession
    rows = _prepared(vectors, id_col, vector_col, label_col)
    grouped = rows.filter("cls is not null").groupBy("cls").agg(
        F.count("*").alias("size"), F.first("label").alias("label"), F.first("dimensions").alias("dimensions"), F.first("vec").alias("vec")
    )
    classes = materialise(grouped, scratch_path(spark, "vector-classes"))
    per_length = classes.groupBy("dimensions").count().orderBy(F.desc("count"), "dimensions").first()
    common = per_length["dimensions"] if per_length else 0
    sampled = classes.filter(F.col("dimensions") == common).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE)
    sample = np.array([r["vec"] for r in sampled.select("vec").collect()], dtype=np.float64).reshape(-1, max(common, 1))
    forest = fit(_unit(sample), per_length["count"] if per_length else 0, least_cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                lengths = part.column("dimensions").to_numpy()
                told = np.flatnonzero(lengths == common)
                other = np.flatnonzero(lengths != common)
                rows, codes = other, np.zeros(len(other), dtype=np.int64)
                if len(told):
                    unit = _unit(np.array(part.column("vec").take(pa.array(told)).to_pylist(), dtype=np.float64))
                    found, leaves = forest.leaves(unit)
                    rows, codes = np.concatenate((rows, told[found])), np.concatenate((codes, leaves))
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                mine = pa.ListArray.from_arrays(pa.array(cuts), pa.array(codes))
                yield pa.RecordBatch.from_arrays([*part.columns, mine], names=[*part.schema.names, "leaves"])

    kind = "cls binary, size bigint, label string, dimensions int, vec array<double>"
    placed = classes.mapInArrow(place, f"{kind}, leaves array<bigint>")
    met = materialise(placed, scratch_path(spark, "vector-leaves"))
    spots = met.select("label", "dimensions", F.explode("leaves").alias("leaf")).groupBy("label", "dimensions", "leaf")
    spots = spots.agg(F.count("*").alias("members")).filter("members > 1")
    share = (spots.agg(F.sum("members").alias("n")).first()["n"] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = min(max(share, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    spots = spots.select("label", "dimensions", "leaf", F.ceil(F.col("members") / F.lit(each)).cast("int").alias("blocks"))
    here = met.withColumn("leaf", F.explode("leaves")).join(spots, ["label", "dimensions", "leaf"])
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = here.withColumn("block", block).withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high")
    cells = dealt.select("cls", "size", "vec", "leaves", "label", "dimensions", "leaf", "block", low, high)

    def compare(table):
        unit = _unit(np.array(table.column("vec").to_pylist(), dtype=np.float64))
        keys = table.column("cls").to_pylist()
        sizes = table.column("size").to_numpy()
        blocks = table.column("block").to_numpy()
        found = links_in(unit, blocks, sizes, table.column("leaves").to_pylist(), table.column("leaf")[0].as_py(), least_cosine)
        counts, rows, roots = found
        other = [None] * len(keys)
        for i, root in zip(rows.tolist(), roots.tolist()):
            other[i] = keys[root]
        return pa.table({"cls": table.column("cls"), "n": pa.array(counts, type=pa.int64()), "other": pa.array(other, type=pa.binary())})

    keyed = cells.groupBy("label", "dimensions", "leaf", "low", "high")
    seen = keyed.applyInArrow(compare, "cls binary, n bigint, other binary").filter("n > 0 or other is not null")
    links = materialise(seen, scratch_path(spark, "vector-links"))
    edges = links.filter("other is not null").select(F.col("cls").alias("src"), F.col("other").alias("dst"))
    roots = connected_components(edges.select(F.explode(F.array("src", "dst")).alias("id")), edges)
    roots = roots.select(F.col("id").alias("cls"), F.col("component").alias("root"))
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    known = classes.select("cls", "size").join(counts, "cls", "left").join(roots, "cls", "left")
    known = known.select("cls", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    members = rows.select("id", "cls").join(known, "cls", "left")
    least = members.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    joined = members.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
