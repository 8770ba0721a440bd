"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed order, gone through twice at most. A document's
virtual finish time is what its queue has handed out when it ends, divided by the source's target;
the mix is the documents of all queues by finish time, up to the total budget. Where that cut falls
is found in two steps, coarse sums first and then the rows of one cell, so no task ever orders more
than a cell: cells of a source are ranges of the hash, cells of the whole are ranges of finish time,
and their number grows with the rows. What comes out is one row per source: its target and, for each
round through the queue, the last hash that is still taken.

Null text has size 0, a null source is a source of its own (the last one), rows that are equal in id
and text are taken together, an empty table gives an empty mix. Columns of the input that carry the
name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import free_names, word_count

# Fixed values of the mix: shares by the source's place, share of all sizes, rounds through a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
ROUNDS = 2
CELL_ROWS = 4_000
# Up to so many sources their plan is broadcast (some tens of MB); beyond, Spark joins by sorting.
BROADCAST_SOURCES = 100_000


def order_key(id_col: str, text_col: str, seed: int) -> Column:
    """Where a document stands in its source's queue, from 0 to below 2^62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), 2)


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """`(id, source, size, key)` of every document, without texts."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        order_key(id_col, text_col, seed).alias("key"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = ROUNDS) -> DataFrame:
    """`(source, source_size, n, target)`; targets share `share` of all sizes by weight.

    No target exceeds `most` times its source's size; what is above goes to the others by weight. All
    sources rise together until they are full, so the level is where the filled ones leave enough.
    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everyone = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    filling = everyone.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everyone) * float(share)
    levels = full.withColumn("level", (budget - before) / open_weight)
    # the level rises with every source that is filled and falls with every one counted full too early
    target = F.least(F.col("cap"), F.max("level").over(everyone) * F.col("w"))
    return levels.withColumn("target", target).select("source", "source_size", "n", "target")


def plan(sizes: DataFrame, shares: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`(source, source_size, target, cut_1, cut_2, ...)`: what is taken of each source in each round.

    `sizes` should be stored, it is read several times. A document of round r with a key up to
    `cut_r` is in the mix; null: none is.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cells = F.ceil(F.col("n") / F.lit(CELL_ROWS))
    width = F.ceil(F.lit(float(1 << 62)) / cells)
    marked = sizes.alias("s").join(_small(shares).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    marked = marked.select("s.source", "s.size", "s.key", "t.source_size", "t.target", F.floor(F.col("key") / width).alias("cell"))

    in_source = Window.partitionBy("source").orderBy("cell")
    sums = marked.groupBy("source", "cell").agg(F.sum("size").alias("held"))
    offsets = sums.withColumn("offset", F.sum("held").over(in_source) - F.col("held")).drop("held")
    in_cell = Window.partitionBy("source", "cell").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    located = marked.withColumn("upto", F.sum("size").over(in_cell))
    on = same(located, offsets) & (located["cell"] == offsets["cell"])
    queued = located.join(offsets, on).select(
        located["source"], "size", "key", "source_size", "target", (F.col("upto") + F.col("offset")).alias("upto")
    )
    rounds_of = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    finish = F.when(F.col("target") > 0, (F.col("round") * F.col("source_size") + F.col("upto")) / F.col("target"))
    entries = queued.withColumn("round", rounds_of).withColumn("finish", finish).filter(F.col("finish").isNotNull())
    entries = materialise(
        entries.select("source", "size", "key", "round", "finish"), scratch_path(sizes.sparkSession, "mix-queue")
    )

    whole = shares.agg(F.sum("target").alias("budget"), F.sum("n").alias("n")).first()
    slots = max(-(-(whole["n"] or 0) // CELL_ROWS), 64)
    # rounding must not keep the last document of the budget out
    allowed = (whole["budget"] or 0.0) * (1 + 1e-12)
    slotted = entries.withColumn("slot", F.floor(F.col("finish") * slots))
    by_slot = slotted.groupBy("slot").agg(F.sum("size").alias("held"))
    filled = by_slot.withColumn("upto", F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("slot")))
    crossed = filled.filter(F.col("upto") > allowed).agg(
        F.min("slot").alias("slot"), F.min(F.col("upto") - F.col("held")).alias("before")
    )
    cut = crossed.first()
    taken = slotted
    if cut["slot"] is not None:
        order = Window.partitionBy(F.lit(0)).orderBy("finish", "round", F.col("source").asc_nulls_last(), "key")
        order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = slotted.filter(F.col("slot") == cut["slot"])
        upto = F.lit(cut["before"]) + F.sum("size").over(order)
        place = F.struct("finish", "round", F.col("source").isNull().alias("none"), "source", "key")
        out = inside.withColumn("upto", upto).filter(F.col("upto") > allowed).agg(F.min(place).alias("p")).first()["p"]
        bound = [F.lit(out[c]).cast(t) for c, t in zip(("finish", "round", "none", "source", "key"), ("double", "int", "boolean", "string", "bigint"))]
        taken = slotted.filter(place < F.struct(*bound))
    cuts = taken.groupBy("source").agg(
        *[F.max(F.when(F.col("round") == r, F.col("key"))).alias(f"cut_{r + 1}") for r in range(rounds)]
    )
    return shares.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
        "t.source", "t.source_size", "t.target", *[f"c.cut_{r + 1}" for r in range(rounds)]
    )


def _small(per_source: DataFrame) -> DataFrame:
    """Marks a table of one row per source for broadcast after a look at its size."""
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(per_source) if few else per_source


def times_taken(rounds: int = ROUNDS) -> Column:
    parts = [F.when(F.col("key") <= F.col(f"cut_{r + 1}"), 1).otherwise(0) for r in range(rounds)]
    return sum(parts[1:], parts[0])


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """`(id, size, source_size, target, times, taken)` of every document: how often, and how many words."""
    spark = docs.sparkSession
    sizes = materialise(measured(docs, id_col, text_col, source_col, seed), scratch_path(spark, "mix-sizes"))
    shares = materialise(targets(sizes), scratch_path(spark, "mix-shares"))
    cuts = materialise(plan(sizes, shares), scratch_path(spark, "mix-plan"))
    joined = sizes.alias("s").join(_small(cuts).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    counted = joined.withColumn("times", times_taken())
    return counted.select("id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken; columns as they were."""
    spark = docs.sparkSession
    sizes = materialise(measured(docs, id_col, text_col, source_col, seed), scratch_path(spark, "mix-sizes"))
    shares = materialise(targets(sizes), scratch_path(spark, "mix-shares"))
    cuts = materialise(plan(sizes, shares), scratch_path(spark, "mix-plan"))
    plans, key, times, copy = free_names(docs.columns, 4)
    chosen = _small(cuts.select(F.struct("*").alias(plans)))
    keyed = docs.withColumn(key, order_key(id_col, text_col, seed))
    joined = keyed.join(chosen, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(f"{plans}.source")))
    parts = [F.when(F.col(key) <= F.col(f"{plans}.cut_{r + 1}"), 1).otherwise(0) for r in range(ROUNDS)]
    repeated = joined.withColumn(times, sum(parts[1:], parts[0])).filter(F.col(times) > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return repeated.withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])
