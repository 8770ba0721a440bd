"""Spatial joins over grid cells: points in polygons, points within a distance, ring measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import (
    EARTH_RADIUS_M,
    cell_id,
    haversine_m,
    ring_area,
    ring_contains,
    ring_edges,
    ring_perimeter,
)
from ..session import materialise, scratch_path
from .skew import salted_join


# A round of refinement cuts a cell into 4^STEP; after ROUNDS of them a cell on the ring stays as it is.
STEP, ROUNDS = 2, 3


# An edge meets a closed box when no axis and not the edge's own line keeps them apart.
_BESIDE = ", ".join(f"(e.b.x - e.a.x) * ({y} - e.a.y) - (e.b.y - e.a.y) * ({x} - e.a.x)" for x in ("west", "east") for y in ("south", "north"))
_TOUCHING = f"""filter(edges, e -> least(e.a.x, e.b.x) <= east AND greatest(e.a.x, e.b.x) >= west
    AND least(e.a.y, e.b.y) <= north AND greatest(e.a.y, e.b.y) >= south AND least({_BESIDE}) <= 0 AND greatest({_BESIDE}) >= 0)"""


def polygon_cover(polygons: DataFrame, res: float) -> DataFrame:
    """`(poly_id, level, cell, inner, ring_key)`: disjoint grid cells that cover each ring of `(poly_id, ring)`.

    A cell of level n is `res * 2^n` wide. A ring begins with at most four cells as wide as itself;
    cells on its border are cut further, but not below `res` and not more than `ROUNDS` times, so a ring
    has at most `4 * 16^ROUNDS` cells whatever its size, and mostly a few hundred. All points of an
    `inner` cell are inside. Everything is worked out where the polygon is.
    """
    of = lambda axis: F.transform("ring", lambda p: p[axis])
    low = {axis: F.array_min(of(axis)) for axis in "xy"}
    high = {axis: F.array_max(of(axis)) for axis in "xy"}
    extent = F.greatest(high["x"] - low["x"], high["y"] - low["y"])
    level = F.ceil(F.greatest(F.log2(F.greatest(extent / F.lit(res), F.lit(1.0))), F.lit(0.0)) / STEP).cast("int") * STEP
    width = F.lit(res) * F.pow(F.lit(2.0), F.col("level"))

    def cells(axis: str) -> Column:
        return F.explode(F.sequence(F.floor(low[axis] / width), F.floor(high[axis] / width)))

    found = polygons.filter(F.size("ring") >= 3).select("poly_id", "ring", level.alias("level"))
    found = found.select("*", ring_edges(F.col("ring")).alias("edges"), cells("x").alias("x")).select("*", cells("y").alias("y"))
    found = _classified(found.withColumn("inner", F.lit(False)), width)
    many = 1 << STEP
    parts = f"""transform(sequence(0, {many * many - 1}), i -> struct(
        level - {STEP} AS level, x * {many} + i % {many} AS x, y * {many} + i div {many} AS y))"""
    for _ in range(ROUNDS):
        cut = F.expr(f"explode(if(inner OR level < {STEP}, array(struct(level, x, y)), {parts}))")
        found = found.select("poly_id", "ring", "edges", "inner", cut.alias("c")).select("poly_id", "ring", "edges", "inner", "c.*")
        found = _classified(found, width)
    key = F.xxhash64("ring").alias("ring_key")
    return found.select("poly_id", "level", cell_id(F.col("x"), F.col("y")).alias("cell"), "inner", key)


def _classified(cells: DataFrame, width: Column) -> DataFrame:
    """Cells with the edges that touch them; those without any are inner or left out."""
    kept = ["poly_id", "ring", "level", "x", "y", "inner"]
    sized = cells.select(*kept, "edges", width.alias("w"))
    # wider by more than what rounding can move a point to the next cell
    margin = sized.selectExpr("*", "w * 1e-6 + greatest(abs(x * w), abs(y * w)) * 1e-12 AS m")
    boxed = margin.selectExpr(*kept, "edges", "w", "x * w - m AS west", "y * w - m AS south", "x * w + w + m AS east", "y * w + w + m AS north")
    # explode of one element: what it holds is worked out once, not wherever a later step uses it
    met = boxed.selectExpr(*kept, "w", f"explode(array(if(inner, slice(edges, 1, 0), {_TOUCHING}))) AS edges")
    middle = ((F.col("x") + 0.5) * F.col("w"), (F.col("y") + 0.5) * F.col("w"))
    alone = F.when(F.size("edges") == 0, F.col("inner") | ring_contains(F.col("ring"), *middle)).otherwise(F.lit(False))
    marked = met.select(*[c for c in kept if c != "inner"], "edges", F.explode(F.array(alone)).alias("inner"))
    return marked.filter(F.col("inner") | (F.size("edges") > 0))


def points_in_polygons(points: DataFrame, polygons: DataFrame, res: float) -> DataFrame:
    """`(point_id, poly_id)` for points `(point_id, lon, lat)` in rings `(poly_id, ring)`; planar.

    Points meet the cells of `polygon_cover` at the few levels that it has. Points of inner cells
    need no test; the others are tested against their ring, which meets them by polygon. The points
    of a crowded cell or polygon are dealt over many tasks. A point on an edge counts as inside, a
    ring of fewer than three points holds nothing. `res` is the finest cell's edge; it changes the
    time and not the result. Cover and candidates are stored in the shared folder.
    """
    spark = points.sparkSession
    cover = materialise(polygon_cover(polygons, res), scratch_path(spark, "cover"))
    # one number per level, of which there are as many as doublings between `res` and the widest ring
    levels = [r[0] for r in cover.select("level").distinct().collect()]
    if not levels:
        return points.select("point_id", F.lit(None).cast(polygons.schema["poly_id"].dataType).alias("poly_id")).filter(F.lit(False))
    x, y = (F.floor(F.col(c) / F.lit(res)) for c in ("lon", "lat"))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), cell_id(F.shiftright(x, n), F.shiftright(y, n)).alias("cell")) for n in levels]))
    located = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("point_id", "lon", "lat", at.alias("at"))
    located = located.select("point_id", "lon", "lat", "at.*")
    met = salted_join(located, cover, ["level", "cell"]).select("point_id", "lon", "lat", "poly_id", "inner", "ring_key")
    met = materialise(met, scratch_path(spark, "candidates"))
    rings = polygons.filter(F.size("ring") >= 3).select("poly_id", F.xxhash64("ring").alias("ring_key"), "ring").dropDuplicates(["poly_id", "ring_key"])
    tested = salted_join(met.filter(~F.col("inner")), rings, ["poly_id", "ring_key"])
    tested = tested.filter(ring_contains(F.col("ring"), F.col("lon"), F.col("lat")))
    return met.filter("inner").select("point_id", "poly_id").unionByName(tested.select("point_id", "poly_id"))


def within(a: DataFrame, b: DataFrame, metres: float, res: float | None = None) -> DataFrame:
    """`(a_id, b_id, metres)` for points `(id, lon, lat)` at most `metres` apart on the sphere.

    Distances are computed between distinct positions, so a place that holds a third of the
    points is one position; ids are attached to the positions that matched. A position of `b` is
    listed under every cell its circle can reach, across the date line and around the poles too.
    `res` is the cell edge in degrees, by default about the distance.
    """
    delta = metres / EARTH_RADIUS_M
    res = res or max(math.degrees(delta), 1e-6)
    columns = math.ceil(360.0 / res)

    def places(df: DataFrame) -> DataFrame:
        kept = df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        return kept.select("lon", "lat").distinct()

    def wrapped(lon: Column) -> Column:
        return lon - F.floor((lon + 180.0) / 360.0) * 360.0

    def row_of(lat: Column) -> Column:
        return F.floor((lat + 90.0) / F.lit(res))

    def columns_in(row: Column) -> Column:
        """Cells in a row: their edge stays about the same length on the ground, so near a pole there are few."""
        low = row * F.lit(res) - 90.0
        nearest = F.when((low <= 0) & (low + res >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(low + res), F.lit(90.0)))
        return F.greatest(F.lit(1), F.floor(F.lit(columns) * F.cos(F.radians(nearest)))).cast("bigint")

    def column_of(lon: Column, n: Column) -> Column:
        return F.least(F.floor((lon + 180.0) / 360.0 * n), n - 1)

    located = places(a).withColumn("_y", row_of(F.col("lat"))).withColumn("_n", columns_in(F.col("_y")))
    left = located.select(
        F.col("lon").alias("a_lon"),
        F.col("lat").alias("a_lat"),
        cell_id(column_of(wrapped(F.col("lon")), F.col("_n")), F.col("_y")).alias("cell"),
    )
    lat_r = F.radians("lat")
    at_pole = F.abs(lat_r) + F.lit(delta) >= F.lit(math.pi / 2)
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(delta, math.pi / 2))) / F.cos(lat_r))))
    margin = F.lit(1e-9)
    lon, n = wrapped(F.col("lon")), F.col("_n")
    west, east = lon - reach - margin, lon + reach + margin
    first, last = F.lit(0).cast("bigint"), n - 1
    everywhere = at_pole | (reach * 2 >= 359.0)
    xs = (
        F.when(everywhere, F.sequence(first, last))
        .when(west < -180, F.concat(F.sequence(first, column_of(east, n)), F.sequence(column_of(west + 360, n), last)))
        .when(east >= 180, F.concat(F.sequence(column_of(west, n), last), F.sequence(first, column_of(east - 360, n))))
        .otherwise(F.sequence(column_of(west, n), column_of(east, n)))
    )
    spread = F.lit(math.degrees(delta)) + margin
    ys = F.sequence(row_of(F.col("lat") - spread), row_of(F.col("lat") + spread))
    right = (
        places(b)
        .withColumn("_y", F.explode(ys))
        .withColumn("_n", columns_in(F.col("_y")))
        .withColumn("_x", F.explode(F.array_distinct(xs)))
        .select(F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"), cell_id(F.col("_x"), F.col("_y")).alias("cell"))
    )
    distance = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    near = (
        salted_join(left, right, ["cell"])
        .withColumn("metres", distance)
        .filter(F.col("metres") <= F.lit(metres))
        .select("a_lon", "a_lat", "b_lon", "b_lat", "metres")
    )
    from_a = a.select(F.col("id").alias("a_id"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
    from_b = b.select(F.col("id").alias("b_id"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    with_a = salted_join(from_a, near, ["a_lon", "a_lat"])
    return salted_join(from_b, with_a, ["b_lon", "b_lat"]).select("a_id", "b_id", "metres")


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """`(poly_id, area, perimeter, compactness)` in planar coordinate units; compactness is 4πA/P²."""
    measured = polygons.select("poly_id", ring_area(F.col("ring")).alias("area"), ring_perimeter(F.col("ring")).alias("perimeter"))
    compactness = F.when(
        F.col("perimeter") > 0, F.lit(4 * math.pi) * F.col("area") / (F.col("perimeter") * F.col("perimeter"))
    )
    return measured.withColumn("compactness", compactness)
