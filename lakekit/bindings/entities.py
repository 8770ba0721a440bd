"""Graph, record linkage and spatial queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, cell
from ..operators import graph, linkage, spatial
from ..session import materialise, scratch_path
from .common import table

# --- graph --------------------------------------------------------------------------------------


def _graph(spark, folder):
    """Customers and nations as nodes; orders as edges, some of which point nowhere."""
    c, n, o = (table(spark, folder, t) for t in ("customer", "nation", "orders"))
    records = {
        "customer": c.filter(F.col("c_acctbal") > 0).withColumn("id", F.concat(F.lit("c"), F.col("c_custkey"))),
        "nation": n.withColumn("id", F.concat(F.lit("n"), F.col("n_nationkey"))),
        "lives_in": c.select(
            F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst")
        ),
        "ordered": o.select(
            F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst")
        ),
    }
    return graph.graph_tables(
        records,
        [("customer", "id", ["c_custkey"]), ("nation", "id", ["n_name"])],
        [("lives_in", "src", "dst"), ("ordered", "src", "dst")],
    )


def graph_nodes(spark, folder):
    return _graph(spark, folder)[0]


def graph_edges(spark, folder):
    return _graph(spark, folder)[1]


def graph_dangling(spark, folder):
    return _graph(spark, folder)[2]


def components(spark, folder):
    """Customers chained to the next key; a negative balance breaks the chain behind it."""
    c = table(spark, folder, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"))
    links = c.filter(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst")
    )
    whole, _ = graph.split_edges(nodes, links)
    return graph.connected_components(nodes, whole)


def components_hubs(spark, folder):
    """Orders linked to their customer and customers to their nation: few hubs, many leaves."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    order_id = F.col("o_orderkey") + F.lit(10**12)
    customer_id = F.lit(10**9) + F.col("c_custkey")
    nodes = c.select(customer_id.alias("id")).unionByName(o.select(order_id.alias("id")))
    edges = c.select(customer_id.alias("src"), F.col("c_nationkey").cast("bigint").alias("dst")).unionByName(
        o.select(order_id.alias("src"), (F.lit(10**9) + F.col("o_custkey")).alias("dst"))
    )
    return graph.connected_components(nodes, edges)


def components_added(spark, folder):
    """The customers' chains in two steps: labels of three links of four are stored, the others join them."""
    c = table(spark, folder, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"))
    key = F.col("c_custkey")
    links = c.filter(F.col("c_acctbal") >= 0).select(key.alias("src"), (key + 1).alias("dst"))
    whole, _ = graph.split_edges(nodes, links)
    old = nodes.filter(F.col("id") % 10 != 7)
    first, _ = graph.split_edges(old, whole.filter(F.col("src") % 4 != 0))
    labels = graph.connected_components(old, first)
    labels = materialise(labels, scratch_path(spark, "labels"))
    return graph.merge_components(labels, nodes, whole.join(first, ["src", "dst"], "left_anti"))


# --- record linkage -----------------------------------------------------------------------------


def normalise_names(spark, folder):
    p = table(spark, folder, "part")
    dressed = p.select(
        "p_partkey",
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Dr. "), F.col("p_name")))
        .when(F.col("p_type") == "SMALL", F.concat(F.split("p_name", " ")[1], F.lit(",  "), F.split("p_name", " ")[0]))
        .when(F.col("p_type") == "PROMO", F.concat(F.col("p_name"), F.lit(", jr.")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("é"), F.col("p_name"), F.lit(" III")))
        .otherwise(F.col("p_name"))
        .alias("name"),
    )
    return linkage.normalise_names(dressed, "name")


def blocking_keys(spark, folder):
    c = table(spark, folder, "customer")
    return linkage.blocking_keys(
        c,
        "c_custkey",
        {
            "nation": F.col("c_nationkey"),
            "rich": F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")),
            "prefix": linkage.prefix(F.col("c_mktsegment"), 3),
        },
    )


def blocking_sounds(spark, folder):
    """Parts by the sound of both words of their name, and by cells of price and size."""
    p = table(spark, folder, "part")
    rules = {
        "sound": linkage.phonetic(F.col("p_name")),
        "last": linkage.phonetic(F.split("p_name", " ")[1]),
        "place": linkage.cell_keys(F.col("p_retailprice") / 100, F.col("p_size").cast("double"), 4.0),
    }
    return linkage.blocking_keys(p, "p_partkey", rules)


def linkage_sounds(spark, folder):
    """Pairs of parts of a size with a level for names that sound alike."""
    p = table(spark, folder, "part").withColumnRenamed("p_partkey", "id")
    keys = linkage.blocking_keys(p, "id", {"size": F.col("p_size")})
    pairs = linkage.candidate_pairs(keys, p.select("id", "p_name"), "p_name", 2)
    return linkage.compare(pairs, p, {"p_name": ["exact", "phonetic", ("edit", 1)]})


def block_sizes(spark, folder):
    return linkage.block_sizes(blocking_keys(spark, folder), above=100)


def _customer_pairs(spark, folder, edits=1):
    c = table(spark, folder, "customer")
    keys = linkage.blocking_keys(
        c, "c_custkey", {"nation": F.col("c_nationkey"), "rich": F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))}
    )
    return linkage.candidate_pairs(keys, c.select(F.col("c_custkey").alias("id"), "c_name"), "c_name", edits)


def linkage_pairs(spark, folder):
    return _customer_pairs(spark, folder)


def linkage_pairs_repeated(spark, folder):
    """Parts of a brand, few distinct names: copies hang on their smallest id."""
    p = table(spark, folder, "part")
    keys = linkage.blocking_keys(p, "p_partkey", {"brand": F.col("p_brand")})
    return linkage.candidate_pairs(keys, p.select(F.col("p_partkey").alias("id"), "p_name"), "p_name", 2)


def _vectors(spark, folder):
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")
    fields = {"c_name": ["exact", ("edit", 1)], "c_mktsegment": ["exact"], "c_nationkey": ["exact"]}
    return linkage.compare(_customer_pairs(spark, folder), c, fields)


# M and u per field and level.
PARAMETERS = {
    "c_name": {2: (0.8, 0.01), 1: (0.15, 0.09), 0: (0.05, 0.9)},
    "c_mktsegment": {1: (0.9, 0.2), 0: (0.1, 0.8)},
    "c_nationkey": {1: (0.95, 0.04), 0: (0.05, 0.96)},
}


def linkage_vectors(spark, folder):
    return _vectors(spark, folder)


def linkage_score(spark, folder):
    return linkage.score(_vectors(spark, folder), PARAMETERS).select("l", "r", F.round("weight", 6).alias("weight"))


def linkage_clusters(spark, folder):
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")
    return linkage.resolve(c, linkage.score(_vectors(spark, folder), PARAMETERS), threshold=6.0)


def linkage_estimate(spark, folder):
    """m and u of every level, estimated from the customers' pairs, and the share of matches."""
    params, share = linkage.estimate(_vectors(spark, folder), ["c_name", "c_mktsegment", "c_nationkey"])
    rows = [(f, v, float(m), float(u), float(share)) for f, levels in params.items() for v, (m, u) in levels.items()]
    found = spark.createDataFrame(rows, "field string, level int, m double, u double, share double")
    return found.select("field", "level", *[F.round(c, 8).alias(c) for c in ("m", "u", "share")])


# --- spatial ------------------------------------------------------------------------------------


def _points(spark, folder):
    """Orders as points: price across, days since 1995 up."""
    o = table(spark, folder, "orders")
    days = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_totalprice") / 5000).alias("lon"), (days / 100.0).alias("lat"))


def _polygons(spark, folder):
    """A diamond per nation, of half width 3 around (4 * key, 6 * region)."""
    n = table(spark, folder, "nation")
    x, y = F.col("n_nationkey") * 4.0, F.col("n_regionkey") * 6.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(3, 0), corner(0, 3), corner(-3, 0), corner(0, -3))
    return n.select(F.col("n_nationkey").alias("poly_id"), ring.alias("ring"))


def cells(spark, folder):
    p = _points(spark, folder)
    return p.select("point_id", cell(F.col("lon"), F.col("lat"), 0.5).alias("cell"))


def points_in_polygons(spark, folder):
    return spatial.points_in_polygons(_points(spark, folder), _polygons(spark, folder), 1.0)


def points_in_wide_polygons(spark, folder):
    """Diamonds from narrow to wider than all points, with cells of a thousandth of the widest and less."""
    n = table(spark, folder, "nation")
    x, y, half = F.col("n_nationkey") * 4.0, F.col("n_regionkey") * 6.0, F.pow(F.lit(4.0), F.col("n_regionkey"))
    corner = lambda dx, dy: F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))
    inside = spatial.points_in_polygons(_points(spark, folder), n.select(F.col("n_nationkey").alias("poly_id"), ring.alias("ring")), 0.25)
    return inside.groupBy("poly_id").agg(F.count("*").alias("points"), F.sum("point_id").alias("id_sum"))


def _places(spark, folder, name, key):
    d = table(spark, folder, name)
    c = name[0]
    return d.select(
        F.col(key).alias("id"), (F.col(f"{c}_acctbal") / 100).alias("lon"), (F.col(f"{c}_nationkey") * 3.0 - 30).alias("lat")
    )


def within(spark, folder):
    """Suppliers and customers at most 150 km apart."""
    near = spatial.within(
        _places(spark, folder, "supplier", "s_suppkey"), _places(spark, folder, "customer", "c_custkey"), 150000.0
    )
    return near.select("a_id", "b_id", F.round("metres", 2).alias("metres"))


def polygon_measures(spark, folder):
    """Measures of a right triangle per part, with the price and the size as legs."""
    p = table(spark, folder, "part")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(zero, zero), at(F.col("p_retailprice"), zero), at(zero, F.col("p_size")))
    measured = spatial.polygon_measures(p.select(F.col("p_partkey").alias("poly_id"), ring.alias("ring")))
    return measured.select(
        "poly_id", *[F.round(c, 6).alias(c) for c in ("area", "perimeter", "compactness")]
    )


QUERIES = {
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_dangling": graph_dangling,
    "components": components,
    "components_hubs": components_hubs,
    "components_added": components_added,
    "normalise_names": normalise_names,
    "blocking_keys": blocking_keys,
    "blocking_sounds": blocking_sounds,
    "linkage_sounds": linkage_sounds,
    "block_sizes": block_sizes,
    "linkage_pairs": linkage_pairs,
    "linkage_pairs_repeated": linkage_pairs_repeated,
    "linkage_vectors": linkage_vectors,
    "linkage_score": linkage_score,
    "linkage_clusters": linkage_clusters,
    "linkage_estimate": linkage_estimate,
    "cells": cells,
    "points_in_polygons": points_in_polygons,
    "points_in_wide_polygons": points_in_wide_polygons,
    "within": within,
    "polygon_measures": polygon_measures,
}

_NODES = """nodes AS (
    SELECT 'c' || c_custkey AS id, 'customer' AS kind, '{"c_custkey":' || c_custkey || '}' AS attributes
    FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT 'n' || n_nationkey, 'nation', '{"n_name":"' || n_name || '"}' FROM nation)"""
_EDGES = """edges AS (
    SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS kind FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'ordered' FROM orders)"""
_KEYS = """keys AS (
    SELECT c_custkey AS id, 'nation' AS rule, CAST(c_nationkey AS VARCHAR) AS block, c_name AS value FROM customer
    UNION ALL SELECT c_custkey, 'rich', c_mktsegment, c_name FROM customer WHERE c_acctbal > 5000)"""
_PART_KEYS = "keys AS (SELECT p_partkey AS id, 'brand' AS rule, p_brand AS block, p_name AS value FROM part)"


def _pairs(keys, edits):
    return f"""{keys},
        reps AS (SELECT rule, block, value, min(id) AS rep FROM keys GROUP BY ALL),
        pairs AS (
            SELECT DISTINCT rep AS l, id AS r, 'same' AS kind FROM keys JOIN reps USING (rule, block, value) WHERE id <> rep
            UNION ALL
            SELECT DISTINCT a.rep, b.rep, 'near' FROM reps a JOIN reps b
                ON a.rule = b.rule AND a.block = b.block AND a.rep < b.rep AND levenshtein(a.value, b.value) <= {edits}
            WHERE a.value <> b.value)"""


_VECTORS = f"""{_pairs(_KEYS, 1)},
    vectors AS (
        SELECT l, r, kind,
               CASE WHEN a.c_name = b.c_name THEN 2 WHEN levenshtein(a.c_name, b.c_name) <= 1 THEN 1 ELSE 0 END AS c_name_level,
               CAST(a.c_mktsegment = b.c_mktsegment AS INTEGER) AS c_mktsegment_level,
               CAST(a.c_nationkey = b.c_nationkey AS INTEGER) AS c_nationkey_level
        FROM pairs JOIN customer a ON a.c_custkey = l JOIN customer b ON b.c_custkey = r),
    scored AS (
        SELECT l, r, CASE c_name_level WHEN 2 THEN log2(0.8 / 0.01) WHEN 1 THEN log2(0.15 / 0.09) ELSE log2(0.05 / 0.9) END
             + CASE c_mktsegment_level WHEN 1 THEN log2(0.9 / 0.2) ELSE log2(0.1 / 0.8) END
             + CASE c_nationkey_level WHEN 1 THEN log2(0.95 / 0.04) ELSE log2(0.05 / 0.96) END AS weight
        FROM vectors)"""



def _estimate(fields=("c_name", "c_mktsegment", "c_nationkey"), iterations=20, prior=0.1):
    """Expectation maximisation as a recursive query: a row per level pattern, its match probability step by step."""
    levels = [f"{f}_level" for f in fields]
    kept = ", ".join(levels)
    counts = ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in levels)
    sums = ", ".join(f"sum(DISTINCT pow(2.0, {c} + 1)) AS up_{c}, sum(DISTINCT pow(2.0, -{c} - 1)) AS down_{c}" for c in levels)
    begin = ", ".join(f"pow(2.0, {c} + 1) / up_{c} AS m_{c}, pow(2.0, -{c} - 1) / down_{c} AS u_{c}" for c in levels)

    def part(c, weight):
        return f"(1e-9 + sum({weight}) OVER (PARTITION BY {c})) / (n_{c} * 1e-9 + sum({weight}) OVER ())"

    parts = ", ".join(f"{part(c, 'n * p')} AS m_{c}, {part(c, 'n * (1 - p)')} AS u_{c}" for c in levels)
    step = f"""SELECT k, {kept}, n, {parts},
        least(greatest(sum(n * p) OVER () / sum(n) OVER (), 1e-9), 1 - 1e-9) AS share FROM em, seen"""
    likely = " * ".join(["share", *[f"m_{c}" for c in levels]])
    unlikely = " * ".join(["(1 - share)", *[f"u_{c}" for c in levels]])
    expect = f"{likely} / ({likely} + {unlikely})"
    rows = " UNION ALL ".join(
        f"SELECT DISTINCT '{f}' AS field, CAST({c} AS INTEGER) AS level, round(m_{c}, 8) AS m, round(u_{c}, 8) AS u, round(share, 8) AS share FROM last"
        for f, c in zip(fields, levels)
    )
    return f"""
        WITH RECURSIVE {_VECTORS},
        pattern AS (SELECT {kept}, CAST(count(*) AS DOUBLE) AS n FROM vectors GROUP BY ALL),
        seen AS (SELECT {counts}, {sums} FROM pattern),
        em AS (
            SELECT 1 AS k, {kept}, n, {expect} AS p FROM (SELECT {kept}, n, {begin}, {prior} AS share FROM pattern, seen)
            UNION ALL
            SELECT k + 1, {kept}, n, {expect} FROM ({step} WHERE k < {iterations})),
        last AS ({step} WHERE k = {iterations})
        {rows}"""


_DISTANCE = f"""2 * {EARTH_RADIUS_M} * asin(sqrt(least(1.0,
    pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""

def _sound(text):
    """The phonetic code by its rules in SQL."""
    code = f"regexp_replace(upper({text}), '[^A-Z]', '', 'g')"
    for pattern, sound in linkage.SOUND_RULES:
        code = f"regexp_replace({code}, '{pattern}', '{sound.replace('$', chr(92))}', 'g')"
    code = f"list_transform([{code}], lambda x: left(x, 1) || regexp_replace(substr(x, 2), '{linkage.DROPPED}', '', 'g'))[1]"
    for letter in linkage.DOUBLED:
        code = f"regexp_replace({code}, '{letter}{letter}+', '{letter}', 'g')"
    return f"nullif({code}, '')"


_SIZE_KEYS = "keys AS (SELECT p_partkey AS id, 'size' AS rule, CAST(p_size AS VARCHAR) AS block, p_name AS value FROM part)"
_CELLS = ", ".join(
    f"CAST(CAST(floor((p_retailprice / 100 + {dx}) / 4) AS BIGINT) * 4294967296 + CAST(floor((p_size + {dy}) / 4) AS BIGINT) + 2147483648 AS VARCHAR)"
    for dx in (-2.0, 2.0)
    for dy in (-2.0, 2.0)
)

SQL = {
    "linkage_estimate": _estimate(),
    "graph_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "graph_edges": f"""
        WITH {_NODES}, {_EDGES} SELECT * FROM edges
        WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""",
    "graph_dangling": f"""
        WITH {_NODES}, {_EDGES}, marked AS (
            SELECT *, src NOT IN (SELECT id FROM nodes) AS s, dst NOT IN (SELECT id FROM nodes) AS d FROM edges)
        SELECT src, dst, kind, CASE WHEN s AND d THEN 'both' WHEN s THEN 'src' ELSE 'dst' END AS reason
        FROM marked WHERE s OR d""",
    "components": """
        WITH numbered AS (
            SELECT c_custkey, coalesce(sum(CAST(c_acctbal < 0 AS INTEGER)) OVER (
                ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM customer)
        SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY part) AS component FROM numbered""",
    "components_hubs": """
        SELECT 1000000000 + c_custkey AS id, CAST(c_nationkey AS BIGINT) AS component FROM customer
        UNION ALL SELECT 1000000000000 + o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey""",
    "components_added": """
        WITH numbered AS (
            SELECT c_custkey, coalesce(sum(CAST(c_acctbal < 0 AS INTEGER)) OVER (
                ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM customer)
        SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY part) AS component FROM numbered""",
    "blocking_sounds": f"""
        SELECT p_partkey AS id, 'sound' AS rule, {_sound('p_name')} AS block FROM part
        UNION ALL SELECT p_partkey, 'last', {_sound("split_part(p_name, ' ', 2)")} FROM part
        UNION ALL SELECT p_partkey, 'place', unnest(list_distinct([{_CELLS}])) FROM part""",
    "linkage_sounds": f"""
        WITH {_pairs(_SIZE_KEYS, 2)}
        SELECT l, r, kind, CASE WHEN a.p_name = b.p_name THEN 3 WHEN {_sound('a.p_name')} = {_sound('b.p_name')} THEN 2
                                WHEN levenshtein(a.p_name, b.p_name) <= 1 THEN 1 ELSE 0 END AS p_name_level
        FROM pairs JOIN part a ON a.p_partkey = l JOIN part b ON b.p_partkey = r""",
    "normalise_names": """
        WITH parts AS (
            SELECT *, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b
            FROM part)
        SELECT p_partkey,
               CASE p_type WHEN 'ECONOMY' THEN 'Dr. ' || p_name
                    WHEN 'SMALL' THEN split_part(p_name, ' ', 2) || ',  ' || split_part(p_name, ' ', 1)
                    WHEN 'PROMO' THEN p_name || ', jr.'
                    WHEN 'LARGE' THEN 'é' || p_name || ' III' ELSE p_name END AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'DR ' || a || ' ' || b WHEN 'SMALL' THEN b || ' ' || a
                    WHEN 'PROMO' THEN a || ' ' || b || ' JR'
                    WHEN 'LARGE' THEN 'E' || a || ' ' || b || ' III' ELSE a || ' ' || b END AS name_clean,
               CASE p_type WHEN 'ECONOMY' THEN 'DR' END AS name_title,
               CASE p_type WHEN 'LARGE' THEN 'III' WHEN 'PROMO' THEN 'JR' END AS name_suffix,
               CASE p_type WHEN 'LARGE' THEN 'E' || a ELSE a END AS name_first, b AS name_last
        FROM parts""",
    "blocking_keys": """
        SELECT c_custkey AS id, 'nation' AS rule, CAST(c_nationkey AS VARCHAR) AS block FROM customer
        UNION ALL SELECT c_custkey, 'rich', c_mktsegment FROM customer WHERE c_acctbal > 5000
        UNION ALL SELECT c_custkey, 'prefix', left(c_mktsegment, 3) FROM customer""",
    "block_sizes": """
        SELECT rule, block, count(*) AS records FROM (
            SELECT 'nation' AS rule, CAST(c_nationkey AS VARCHAR) AS block FROM customer
            UNION ALL SELECT 'rich', c_mktsegment FROM customer WHERE c_acctbal > 5000
            UNION ALL SELECT 'prefix', left(c_mktsegment, 3) FROM customer)
        GROUP BY ALL HAVING count(*) > 100""",
    "linkage_pairs": f"WITH {_pairs(_KEYS, 1)} SELECT * FROM pairs",
    "linkage_pairs_repeated": f"WITH {_pairs(_PART_KEYS, 2)} SELECT * FROM pairs",
    "linkage_vectors": f"WITH {_VECTORS} SELECT * FROM vectors",
    "linkage_score": f"WITH {_VECTORS} SELECT l, r, round(weight, 6) AS weight FROM scored",
    "linkage_clusters": f"""
        WITH RECURSIVE {_VECTORS},
        links AS (SELECT l AS a, r AS b FROM scored WHERE weight >= 6 UNION SELECT r, l FROM scored WHERE weight >= 6),
        reach(id, other) AS (
            SELECT c_custkey, c_custkey FROM customer
            UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other)
        SELECT id, min(other) AS entity FROM reach GROUP BY id""",
    "cells": """
        SELECT o_orderkey AS point_id,
               CAST(floor(o_totalprice / 5000 / 0.5) AS BIGINT) * 4294967296
               + CAST(floor(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 100.0 / 0.5) AS BIGINT) + 2147483648 AS cell
        FROM orders""",
    "points_in_polygons": """
        SELECT o_orderkey AS point_id, n_nationkey AS poly_id FROM orders JOIN nation
          ON abs(o_totalprice / 5000 - n_nationkey * 4.0)
             + abs(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 100.0 - n_regionkey * 6.0) <= 3""",
    "points_in_wide_polygons": """
        SELECT n_nationkey AS poly_id, count(*) AS points, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM orders JOIN nation
          ON abs(o_totalprice / 5000 - n_nationkey * 4.0)
             + abs(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 100.0 - n_regionkey * 6.0) <= 4 ** n_regionkey
        GROUP BY n_nationkey""",
    "within": f"""
        WITH a AS (SELECT s_suppkey AS id, s_acctbal / 100 AS lon, s_nationkey * 3.0 - 30 AS lat FROM supplier),
        b AS (SELECT c_custkey AS id, c_acctbal / 100 AS lon, c_nationkey * 3.0 - 30 AS lat FROM customer)
        SELECT a.id AS a_id, b.id AS b_id, round({_DISTANCE}, 2) AS metres FROM a JOIN b ON {_DISTANCE} <= 150000""",
    "polygon_measures": f"""
        WITH t AS (SELECT p_partkey AS poly_id, p_retailprice * p_size / 2 AS area,
                          p_retailprice + p_size + sqrt(p_retailprice * p_retailprice + p_size * p_size) AS perimeter FROM part)
        SELECT poly_id, round(area, 6) AS area, round(perimeter, 6) AS perimeter,
               round(4 * {math.pi} * area / (perimeter * perimeter), 6) AS compactness FROM t""",
}
