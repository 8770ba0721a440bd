"""Joins and time slices that survive a key holding a large part of the rows.

Everything here rests on one bound: fewer than `SHARE` keys can each hold more than one `SHARE`-th of
the rows. A list of such keys is therefore small whatever the data is, and safe to broadcast. With
rows in the trillions a `SHARE`-th is some ten million rows, which one task handles well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 100_000
# below this many rows splitting costs more than it gains
JOIN_ROWS = 200_000
SLICE_ROWS = 1_000_000


def _limit(total: Column, least: int) -> Column:
    """Rows one task may get of a key: a `SHARE`-th of all rows, and at least `least`."""
    return F.greatest(F.lit(least).cast("bigint"), F.ceil(total / F.lit(SHARE)))


def hot_keys(df: DataFrame, on: Sequence[str], pieces: str) -> DataFrame:
    """Keys with more rows than one task may get, and into how many pieces to deal them."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    limit = _limit(counts.select(F.sum("_n")).scalar(), JOIN_ROWS)
    hot = counts.filter(F.col("_n") > limit)
    return hot.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias(pieces))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on `on`; left rows of a hot key are dealt over as many tasks as their number needs.

    Right rows of those few keys are repeated once per piece, all others once. The piece is a hash
    of the left row, so a re-run task deals its rows the same way. Keys are compared with `=`.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(left, on, "_pieces"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_piece", F.pmod(F.xxhash64(*left.columns), pieces).cast("int"))
    repeated = right.join(hot, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_piece"]).drop("_piece")


def lookup_join(left: DataFrame, lookup: DataFrame, on: Sequence[str], rows: str, total: int | Column) -> DataFrame:
    """Inner join with a lookup that is unique on `on` and knows how many left rows a key has.

    `rows` is that count (or an upper bound) and `total` the number of left rows. The entries of hot
    keys are broadcast and their rows are joined where they are; all other rows are shuffled. The
    count is a by-product of building the lookup, so finding the hot keys costs no pass over `left`.
    """
    on = list(on)
    values = [c for c in lookup.columns if c not in (*on, rows)]
    is_hot = F.col(rows) > _limit(F.lit(total) if isinstance(total, int) else total, JOIN_ROWS)
    hot = lookup.filter(is_hot).select(*on, F.struct(*values).alias("_found"))
    marked = left.join(F.broadcast(hot), on, "left")
    there = marked.filter(F.col("_found").isNotNull()).select(*left.columns, *[f"_found.{v}" for v in values])
    rest = marked.filter(F.col("_found").isNull()).drop("_found")
    # the same columns as above, so that Spark builds the lookup once for both
    others = lookup.filter(~is_hot).hint("merge")
    return there.unionByName(rest.join(others, on).select(*left.columns, *values))


def heavy_cells(df: DataFrame, length: int, narrowest: int) -> DataFrame:
    """Time cells of a series that hold too many rows, and the width to cut them into.

    `df` has a series `_key` and a time `_t` in microseconds; cells are `length` wide. Heavy cells
    are cut evenly and never below `narrowest`.
    """
    cell = F.floor(F.col("_t") / F.lit(length))
    counts = df.groupBy("_key", cell.alias("_cell")).agg(F.count("*").alias("_n"))
    limit = _limit(counts.select(F.sum("_n")).scalar(), SLICE_ROWS)
    width = F.greatest(F.ceil(F.lit(length) / F.ceil(F.col("_n") / limit)), F.lit(narrowest))
    heavy = counts.filter(F.col("_n") > limit)
    return F.broadcast(heavy.select("_key", "_cell", width.cast("bigint").alias("_width")))


def with_slice(df: DataFrame, heavy: DataFrame, length: int, at: Column, name: str) -> DataFrame:
    """Add the start of the time slice of `_key` that `at` falls into, as column `name`."""
    located = df.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") / F.lit(length)))
    start = F.col("_cell") * F.lit(length)
    width = F.coalesce(F.col("_width"), F.lit(length))
    begin = start + F.floor((F.col("_at") - start) / width) * width
    return located.join(heavy, ["_key", "_cell"], "left").withColumn(name, begin).drop("_at", "_cell", "_width")
