"""Node and edge tables, and connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path
from .merge import one_per_key
from .skew import lookup_join


def graph_tables(
    records: Mapping[str, DataFrame],
    node_specs: Sequence[tuple[str, str, Sequence[str]]],
    edge_specs: Sequence[tuple[str, str, str]],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges whose ends exist, and dangling edges.

    `node_specs` are `(record set, id column, attribute columns)`, `edge_specs` `(record set, source
    column, destination column)`. Ids of several record sets share one id space; an id that occurs
    twice keeps its smallest row. Dangling edges carry the reason `src`, `dst` or `both`.
    """
    nodes = None
    for name, id_col, attributes in node_specs:
        part = records[name].select(
            F.col(id_col).alias("id"), F.lit(name).alias("kind"), F.to_json(F.struct(*attributes)).alias("attributes")
        )
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = None
    for name, src, dst in edge_specs:
        part = records[name].select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(name).alias("kind"))
        edges = part if edges is None else edges.unionByName(part)
    nodes = one_per_key(nodes.filter(F.col("id").isNotNull()), ["id"])
    return nodes, *split_edges(nodes, edges)


def split_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends exist, and dangling ones with a `reason`; nodes must be unique by id.

    Nodes meet edges by shuffles, never through the driver; adaptive execution splits the edges of a hub.
    """
    ids = nodes.select("id")
    known = ids.withColumn("_there", F.lit(True))
    marked = (
        edges.join(known.withColumnsRenamed({"id": "src", "_there": "_src"}).hint("merge"), "src", "left")
        .join(known.withColumnsRenamed({"id": "dst", "_there": "_dst"}).hint("merge"), "dst", "left")
        .select(*edges.columns, F.col("_src").isNull().alias("_no_src"), F.col("_dst").isNull().alias("_no_dst"))
    )
    whole = marked.filter(~F.col("_no_src") & ~F.col("_no_dst")).select(*edges.columns)
    reason = F.when(F.col("_no_src") & F.col("_no_dst"), "both").when(F.col("_no_src"), "src").otherwise("dst")
    dangling = marked.filter(F.col("_no_src") | F.col("_no_dst")).select(*edges.columns, reason.alias("reason"))
    return whole, dangling


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of its neighbourhood."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = around.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    smallest = smallest.select("v", F.least("m", "v").alias("m"), "n")
    return lookup_join(edges, smallest, ["v"], "n", total).select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = lookup_join(edges, smallest, ["u"], "n", total).filter(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(smallest.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _written(edges: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """Edges as files, and their number and combined hash taken while writing."""
    seen = Observation()
    combined = F.bit_xor(F.xxhash64("u", "v")).alias("hash")
    state = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), combined), path)
    return state, (seen.get["n"], seen.get["hash"])


def connected_components(
    nodes: DataFrame, edges: DataFrame, path: str | None = None, max_rounds: int = 64
) -> DataFrame:
    """`(id, component)`, component being the smallest vertex id; edges count as undirected.

    Alternates large-star and small-star steps until the edges stop changing, which takes few
    rounds even on long chains. A vertex is only ever met through its minimum, never through a
    list of neighbours, and the minimum of a hub is broadcast to its edges instead of moving them
    into one task. The edges of
    every step are written below `path` (by default in the shared folder), which ends the
    lineage; the round before is deleted. Of vertices and edges only counts and the minima of hubs
    pass through the driver.
    """
    spark = nodes.sparkSession
    path = path or scratch_path(spark, "components")
    start = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    state, seen = _written(start, f"{path}/round-0")
    for n in range(1, max_rounds + 1):
        middle = materialise(_large_star(state, seen[0]), f"{path}/round-{n}-large")
        state, now = _written(_small_star(middle, seen[0]), f"{path}/round-{n}")
        delete_path(spark, f"{path}/round-{n}-large")
        delete_path(spark, f"{path}/round-{n - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("u").alias("id"), F.col("v").alias("_root"))
    ids = nodes.select("id").distinct()
    return ids.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def component_changes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`(component, merged)`: components of stored `labels (id, component)` that new edges join to a smaller one.

    Only the ends of the new edges are looked up, and the union runs over the components that they
    touch, so the rounds follow the new edges and not the graph. An end without a label is a
    component of its own. Both columns are smallest vertex ids, as in `connected_components`.
    """
    spark = labels.sparkSession
    ends = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    ends = materialise(ends, scratch_path(spark, "new-edges"))
    touched = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    # the labels' side is scanned where it is when the ends are few
    known = materialise(labels.select("id", "component").join(touched, "id", "left_semi"), scratch_path(spark, "touched"))
    for side in ("src", "dst"):
        named = known.select(F.col("id").alias(side), F.col("component").alias("_label"))
        ends = ends.join(named, side, "left").withColumn(side, F.coalesce("_label", side)).drop("_label")
    lifted = materialise(ends.filter(F.col("src") != F.col("dst")).distinct(), scratch_path(spark, "lifted"))
    merged = connected_components(lifted.select(F.explode(F.array("src", "dst")).alias("id")), lifted)
    return merged.filter(F.col("id") != F.col("component")).select(F.col("id").alias("component"), F.col("component").alias("merged"))


def merge_components(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`(id, component)` of the graph with new `nodes (id)` and `edges` added, from the labels before them.

    Equals `connected_components` of the whole graph when components are labelled by smallest ids. Old
    edges are not needed. Stored labels are read once and meet one small row per component that
    changed, of which Spark sends a copy to every task while they are few.
    """
    spark = labels.sparkSession
    changes = materialise(component_changes(labels, edges), scratch_path(spark, "changes"))
    new = nodes.select("id").distinct().join(labels.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    return (
        labels.select("id", "component")
        .unionByName(new)
        .join(changes, "component", "left")
        .select("id", F.coalesce("merged", "component").alias("component"))
    )
