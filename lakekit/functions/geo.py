"""Grid cells, great-circle distance and planar ring tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371008.8
CELL_STRIDE = 4294967296
CELL_OFFSET = 2147483648


def cell_id(x: Column, y: Column) -> Column:
    """One BIGINT for a grid column and row."""
    return x.cast("bigint") * F.lit(CELL_STRIDE) + (y.cast("bigint") + F.lit(CELL_OFFSET))


def cell(lon: Column, lat: Column, res: float) -> Column:
    """Grid cell of a point; `res` is the cell's edge in the units of the coordinates."""
    return cell_id(F.floor(lon / F.lit(res)), F.floor(lat / F.lit(res)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of `struct<x,y>`, closed whether or not the last point repeats the first."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), following.alias("b"))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on an edge is inside; a ring of fewer than three points holds nothing."""

    def step(state: Column, edge: Column) -> Column:
        ax, ay, bx, by = edge["a"]["x"], edge["a"]["y"], edge["b"]["x"], edge["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on_edge = (
            (cross == 0)
            & x.between(F.least(ax, bx), F.greatest(ax, bx))
            & y.between(F.least(ay, by), F.greatest(ay, by))
        )
        straddles = (ay > y) != (by > y)
        # the ray to the right is crossed when the point lies left of the edge
        crosses = straddles & F.when(by > ay, cross > 0).otherwise(cross < 0)
        return F.struct(
            (state["odd"] != crosses).alias("odd"), (state["edge"] | on_edge).alias("edge")
        )

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))
    walked = F.aggregate(ring_edges(ring), start, step, lambda s: s["odd"] | s["edge"])
    return (F.size(ring) >= 3) & walked


def ring_area(ring: Column) -> Column:
    """Planar shoelace area in squared coordinate units."""
    twice = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]),
    )
    return F.abs(twice) / 2


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda s, e: s
        + F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)),
    )
