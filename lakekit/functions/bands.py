"""Threshold bands and value mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(col: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the greatest step not above the value; lower bounds are inclusive.

    The first step has bound None and takes everything below the second one. NULL stays NULL.
    """
    if not steps or steps[0][0] is not None:
        raise ValueError("the first step must have bound None")
    bounds = [b for b, _ in steps[1:]]
    if any(b is None for b in bounds) or bounds != sorted(set(bounds)):
        raise ValueError("bounds must be strictly increasing")
    result = F.when(col.isNull(), F.lit(None).cast("string"))
    for bound, label in reversed(steps[1:]):
        result = result.when(col >= F.lit(bound), F.lit(label))
    return result.otherwise(F.lit(steps[0][1]))


def map_values(col: Column, mapping: Mapping, default: str | None = None) -> Column:
    """Code to label through a literal map; unknown codes give `default`."""
    if not mapping:
        return F.lit(default).cast("string")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.lit(default))


def map_values_table(df: DataFrame, col: str, mapping: DataFrame, label: str, default=None) -> DataFrame:
    """The same with the mapping as a table `(code, label)`; Spark broadcasts it when it is small.

    A code listed twice takes its smallest label, so no row is multiplied.
    """
    code, text = mapping.columns
    lookup = mapping.groupBy(F.col(code).alias("_code")).agg(F.min(text).alias("_label"))
    joined = df.join(lookup, F.col(col) == F.col("_code"), "left")
    return joined.select(*df.columns, F.coalesce(F.col("_label"), F.lit(default)).alias(label))
