import math
import random
from fractions import Fraction
from itertools import combinations

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekit.operators import graph, linkage, skew, spatial
from lakekit.session import materialise, scratch_path

# --- graph --------------------------------------------------------------------------------------


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return sorted((n, root(n)) for n in nodes)


def components(spark, nodes, edges, **how):
    n = spark.createDataFrame([(x,) for x in nodes], "id bigint")
    e = spark.createDataFrame(list(edges), "src bigint, dst bigint")
    return rows(graph.connected_components(n, e, **how))


def test_components_by_hand(spark):
    nodes = list(range(12))
    edges = [(3, 1), (1, 3), (2, 3), (5, 5), (6, 7), (7, 8), (8, 6), (11, 10)]
    assert components(spark, nodes, edges) == union_find(nodes, edges)
    assert components(spark, nodes, []) == [(n, n) for n in nodes]


@pytest.mark.parametrize("least", [1_000_000, 5])
def test_components_long_chain_and_hub(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "JOIN_ROWS", least)
    rnd = random.Random(3)
    order = list(range(60))
    rnd.shuffle(order)
    chain = list(zip(order, order[1:]))
    hub = [(1000, 2000 + i) for i in range(80)]
    nodes = order + [1000] + [2000 + i for i in range(80)]
    assert components(spark, nodes, chain + hub) == union_find(nodes, chain + hub)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_agree_with_union_find(spark, edges):
    nodes = list(range(26))
    assert components(spark, nodes, edges) == union_find(nodes, edges)


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark, range(40), [(i, i + 1) for i in range(39)], max_rounds=1)


def test_vertices_and_edges_never_pass_through_the_driver(spark, capsys):
    nodes = spark.range(50).select("id")
    edges = spark.range(49).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    plans = []
    for df in (*graph.split_edges(nodes, edges), graph.connected_components(nodes, edges)):
        df.explain()
        plans.append(capsys.readouterr().out)
    assert all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans)
    counted = edges.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"))
    skew.lookup_join(edges, counted, ["src"], "n", 49).explain()
    plan = capsys.readouterr().out
    # the hot entries, few whatever the data is, are the only rows sent to all: once for each kind of row
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2


def test_graph_tables(spark):
    people = spark.createDataFrame([("p1", "b"), ("p1", "a"), ("p2", "c"), (None, "d")], "id string, n string")
    knows = spark.createDataFrame([("p1", "p2"), ("p1", "p9"), ("p8", "p2"), ("p8", "p9"), ("p1", "p2")], "a string, b string")
    nodes, edges, dangling = graph.graph_tables({"p": people, "k": knows}, [("p", "id", ["n"])], [("k", "a", "b")])
    assert rows(nodes, "id", "attributes") == [("p1", '{"n":"a"}'), ("p2", '{"n":"c"}')]
    assert rows(edges, "src", "dst") == [("p1", "p2"), ("p1", "p2")]
    assert rows(dangling, "src", "dst", "reason") == [("p1", "p9", "dst"), ("p8", "p2", "src"), ("p8", "p9", "both")]


# --- linkage ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, clean, title, first, last, suffix",
    [
        ("Dr. José  O'Neil, Jr.", "DR JOSE O'NEIL JR", "DR", "JOSE", "O'NEIL", "JR"),
        ("Smith John, Jr.", "SMITH JOHN JR", None, "SMITH", "JOHN", "JR"),
        ("Smith, John, Jr.", "SMITH JOHN JR", None, "JOHN", "SMITH", "JR"),
        ("Smith Jr., Dr. John, MD", "SMITH JR DR JOHN MD", "DR", "JOHN", "SMITH", "JR MD"),
        ("Dr. Hon. A Smith", "DR HON A SMITH", "DR HON", "A", "SMITH", None),
        ("'Quoted' D’Arcy III Esq.", "QUOTED D'ARCY III ESQ", None, "QUOTED", "D'ARCY", "III ESQ"),
        (", ,", "", None, None, None, None),
        ("SMITH, JOHN A", "SMITH JOHN A", None, "JOHN", "SMITH", None),
        ("Mrs. Ada Lovelace III", "MRS ADA LOVELACE III", "MRS", "ADA", "LOVELACE", "III"),
        ("Cher", "CHER", None, None, "CHER", None),
        ("DR", "DR", None, None, "DR", None),
        ("Acme Widgets Inc.", "ACME WIDGETS INC", None, "ACME", "WIDGETS", "INC"),
        ("", "", None, None, None, None),
        (None, None, None, None, None, None),
    ],
)
def test_names(spark, name, clean, title, first, last, suffix):
    r = linkage.normalise_names(spark.createDataFrame([(name,)], "n string"), "n").first()
    assert r.name_clean == clean
    assert (r.name_title, r.name_first, r.name_last, r.name_suffix) == (title, first, last, suffix)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("xy"), st.one_of(st.none(), st.text("abc", max_size=5))), min_size=1, max_size=25),
    st.integers(0, 2),
)
def test_candidates_agree_with_all_pairs(spark, records, edits):
    data = [(i, b, v) for i, (b, v) in enumerate(records)]
    df = spark.createDataFrame(data, "id int, b string, v string")
    keys = linkage.blocking_keys(df, "id", {"block": F.col("b")})
    got = rows(linkage.candidate_pairs(keys, df, "v", edits))
    reps = {}
    for i, b, v in data:
        if v is not None:
            reps.setdefault((b, v), i)
    want = [(reps[(b, v)], i, "same") for i, b, v in data if v is not None and reps[(b, v)] != i]
    for ((b1, v1), r1), ((b2, v2), r2) in combinations(reps.items(), 2):
        if b1 == b2 and levenshtein(v1, v2) <= edits:
            want.append((min(r1, r2), max(r1, r2), "near"))
    assert got == sorted(want)


def test_equal_records_give_a_star(spark):
    df = spark.range(400).select("id", F.lit("same").alias("v"))
    keys = linkage.blocking_keys(df, "id", {"all": F.lit("x")})
    pairs = linkage.candidate_pairs(keys, df, "v")
    assert pairs.count() == 399
    assert rows(linkage.block_sizes(keys, 100)) == [("all", "x", 400)]
    assert {r.entity for r in linkage.resolve(df, pairs).collect()} == {0}


def test_pairs_are_unique_across_rules(spark):
    df = spark.createDataFrame([(1, "anna"), (2, "anne"), (3, None)], "id int, v string")
    keys = linkage.blocking_keys(df, "id", {"a": linkage.prefix(F.col("v"), 2), "b": linkage.phonetic(F.col("v")), "c": F.lit("z")})
    assert rows(linkage.candidate_pairs(keys, df, "v")) == [(1, 2, "near")]


def test_levels_and_score(spark):
    records = spark.createDataFrame([(1, "robert", "x"), (2, "rupert", "x"), (3, "robert", None), (4, "zed", "y")], "id int, n string, s string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "l int, r int")
    vectors = linkage.compare(pairs, records, {"n": ["exact", ("edit", 1), "phonetic"], "s": ["exact"]})
    assert rows(vectors) == [(1, 2, 1, 1), (1, 3, 3, -1), (1, 4, 0, 0)]
    params = {"n": {3: (0.8, 0.1), 1: (0.4, 0.2), 0: (0.1, 0.8)}, "s": {1: (0.9, 0.3), 0: (0.1, 0.7)}}
    weights = {r.r: r.weight for r in linkage.score(vectors, params).collect()}
    assert weights[2] == pytest.approx(math.log2(0.4 / 0.2) + math.log2(3)) and weights[3] == pytest.approx(3)


def test_estimate_finds_the_two_classes(spark):
    rnd = random.Random(1)
    data = []
    for i in range(2000):
        match = rnd.random() < 0.2
        data.append(tuple(int(rnd.random() < (0.9 if match else 0.1)) for _ in range(3)))
    vectors = spark.createDataFrame(data, "a_level int, b_level int, c_level int")
    params, share = linkage.estimate(vectors, ["a", "b", "c"], 60)
    assert share == pytest.approx(0.2, abs=0.05)
    for f in "abc":
        assert params[f][1][0] == pytest.approx(0.9, abs=0.07) and params[f][1][1] == pytest.approx(0.1, abs=0.05)


# --- spatial ------------------------------------------------------------------------------------


def polygon(spark, *rings):
    data = [(i, None if r is None else [tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)]
    return spark.createDataFrame(data, "poly_id int, ring array<struct<x:double,y:double>>")


def test_points_in_polygons_edges(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    dented = [(10, 0), (14, 0), (14, 4), (12, 1), (10, 4)]
    closed = [(20, 0), (22, 0), (22, 2), (20, 2), (20, 0)]
    polygons = polygon(spark, square, dented, closed, [(0, 0), (1, 1)], [], None)
    points = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 2.0), (4, 2.0001, 1.0), (5, 12.0, 2.0), (6, 10.5, 2.0), (7, 12.0, 0.5),
         (8, 21.0, 1.0), (9, 22.0, 0.0), (10, None, 1.0), (11, -1.0, 0.0), (12, 1.0, 0.0)],
        "point_id int, lon double, lat double",
    )
    for res in (0.3, 1.0, 50.0):
        got = rows(spatial.points_in_polygons(points, polygons, res))
        assert got == [(1, 0), (2, 0), (3, 0), (6, 1), (7, 1), (8, 2), (9, 2), (12, 0)]


def in_ring(ring, x, y):
    """Even-odd rule with exact fractions; edges count as inside."""
    x, y = Fraction(x), Fraction(y)
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (cross > 0) == (by > ay):
            odd = not odd
    return odd


@pytest.mark.parametrize("res", [0.01, 0.5, 7.0])
def test_points_in_rings_of_any_size(spark, res):
    """Wide, narrow, jagged, repeated and negative rings against every point; corners, edges and cell borders among them."""
    rnd = random.Random(6)
    star = [(50 + r * math.cos(a), -20 + r * math.sin(a)) for i in range(24) for r, a in [((40, 9)[i % 2], i * math.pi / 12)]]
    rings = [[(-180, -90), (180, -90), (180, 90), (-180, 90)], star, [(0, 0), (0.001, 0), (0, 0.001)], [(-8, -8), (8, -8), (8, 8), (-8, 8)]]
    rings += [[(rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for _ in range(5)] for _ in range(4)]
    spots = [(rnd.uniform(-100, 100), rnd.uniform(-95, 95)) for _ in range(150)]
    spots += [p for ring in rings for p in ring] + [(0.0, 0.0005), (8.0, 0.0), (8.000001, 0.0), (-8.0, -8.0), (0.5, 0.5), (180.0, 0.0), (0.0, 90.0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "point_id int, lon double, lat double")
    got = rows(spatial.points_in_polygons(points, polygon(spark, *rings), res))
    assert got == sorted((i, k) for i, s in enumerate(spots) for k, ring in enumerate(rings) if in_ring(ring, *s))


def test_a_globe_has_a_bounded_cover(spark):
    globe = [(-180, -90), (180, -90), (180, 90), (-180, 90)]
    diamond = [(-180, 0), (0, -90), (180, 0), (0, 90)]
    for ring in (globe, diamond):
        counts = [spatial.polygon_cover(polygon(spark, ring), res).groupBy("inner").count().collect() for res in (1e-6, 1e-3)]
        for found in counts:
            n = {r["inner"]: r["count"] for r in found}
            assert sum(n.values()) <= 4 * 16**spatial.ROUNDS and n[False] < 1200 and n[True] > 50


def test_empty_sides_of_a_polygon_join(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0)], "point_id int, lon double, lat double")
    square = polygon(spark, [(0, 0), (2, 0), (2, 2), (0, 2)])
    assert rows(spatial.points_in_polygons(points.limit(0), square, 1.0)) == []
    assert rows(spatial.points_in_polygons(points, square.limit(0), 1.0)) == []
    twice = square.unionByName(square).unionByName(polygon(spark, [(5, 5), (6, 5), (6, 6)]))
    assert rows(spatial.points_in_polygons(points, twice, 1.0)) == [(1, 0), (1, 0)]


def haversine(a, b):
    (lon1, lat1), (lon2, lat2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("metres", [1000.0, 300000.0])
def test_within_agrees_with_all_pairs(spark, monkeypatch, metres):
    monkeypatch.setattr(skew, "JOIN_ROWS", 5)
    rnd = random.Random(2)

    def spot():
        kind = rnd.randrange(4)
        if kind == 0:  # the date line
            return (rnd.choice([-1, 1]) * (180 - rnd.random() * 2), rnd.uniform(-70, 70))
        if kind == 1:  # a pole
            return (rnd.uniform(-180, 180), rnd.choice([-1, 1]) * (90 - rnd.random() * 2))
        if kind == 2:  # one crowded place
            return (5.0, 50.0)
        return (5 + rnd.random() * 0.05, 50 + rnd.random() * 0.05)

    a, b = [[spot() for _ in range(60)] for _ in range(2)]
    frame = lambda pts: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, lon double, lat double")
    got = rows(spatial.within(frame(a), frame(b), metres), "a_id", "b_id")
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if haversine(p, q) <= metres)
    assert got == want and len(want) > 100


def test_polygon_measures(spark):
    r = {x.poly_id: x for x in spatial.polygon_measures(polygon(spark, [(0, 0), (3, 0), (3, 4)], [(1, 1)])).collect()}
    assert (r[0].area, r[0].perimeter) == (6.0, 12.0) and r[0].compactness == pytest.approx(4 * math.pi * 6 / 144)
    assert r[1].area == 0 and r[1].compactness is None


def test_names_that_sound_alike_share_a_code(spark):
    alike = [("Catherine", "Kathryn"), ("Philip", "Filip"), ("Knight", "Night"), ("Smith", "Smyth"), ("Wright", "Right"), ("Phillips", "Filips"),
             ("Thomson", "Thompson".replace("p", "")), ("Schmidt", "Skmitt"), ("Jeffrey", "Geoffrey"), ("Lamb", "Lam"), ("Xavier", "Zavier"),
             ("Müller", "Muller"), ("Bridget", "Brijet"), ("O'Hara", "OHARA"), ("Stephen", "Steven")]
    apart = [("Smith", "Jones"), ("Karl", "Earl"), ("Bond", "Fond"), ("Robert", "Rolbert"), ("Tate", "Thate"), ("Mason", "Nason")]
    for pairs, same in ((alike, True), (apart, False)):
        df = spark.createDataFrame(pairs, "a string, b string")
        got = df.select("a", "b", linkage.phonetic(F.col("a")).alias("x"), linkage.phonetic(F.col("b")).alias("y")).collect()
        assert [r for r in got if (r.x == r.y) != same] == []
    none = spark.createDataFrame([(None,), ("",), ("123 -",)], "a string")
    assert rows(none.select(linkage.phonetic(F.col("a")).alias("x"))) == [(None,)] * 3


def test_places_nearby_share_a_cell(spark):
    rnd = random.Random(9)
    spots = [(rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for _ in range(120)] + [(0.0, 0.0), (1.0, 1.0), (2.0, -2.0)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)] + [(999, None, 1.0)], "id int, lon double, lat double")
    keys = linkage.blocking_keys(df, "id", {"place": linkage.cell_keys(F.col("lon"), F.col("lat"), 2.0)})
    blocks = {}
    for r in keys.collect():
        blocks.setdefault(r["id"], set()).add(r["block"])
    assert 999 not in blocks and max(map(len, blocks.values())) <= 4
    for i, a in enumerate(spots):
        for j, b in enumerate(spots):
            if abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1:
                assert blocks[i] & blocks[j]


@pytest.mark.parametrize("seed", range(3))
def test_added_edges_give_the_components_of_the_whole(spark, seed):
    rnd = random.Random(seed)
    edge = lambda: (rnd.randrange(60), rnd.randrange(60))
    old, new = [edge() for _ in range(25)], [edge() for _ in range(12)] + [(200, 201), (201, 5), (300, 300)]
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    known = spark.range(50).filter("id % 9 <> 2")
    inside = graph.split_edges(known, frame(old))[0]
    labels = materialise(graph.connected_components(known, inside), scratch_path(spark, "labels"))
    nodes = spark.range(60).unionByName(spark.createDataFrame([(200,), (201,), (300,)], "id long"))
    merged = graph.merge_components(labels, nodes, frame(old + new))
    assert rows(merged) == rows(graph.connected_components(nodes, frame(old + new)))
    # no new edge between components, nothing to change
    assert graph.component_changes(labels, inside).count() == 0
    touched = {n for e in new[:1] for n in e}
    assert graph.component_changes(labels, frame(new[:1])).count() <= len(touched)


def test_entities_grow_with_new_pairs(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    first = spark.createDataFrame([(1, 2, 9.0), (3, 4, 1.0)], "l long, r long, weight double")
    entities = materialise(linkage.resolve(records.filter("id < 6"), first, 5.0), scratch_path(spark, "entities"))
    more = spark.createDataFrame([(2, 6, 9.0), (6, 7, 9.0), (5, 1, 0.1)], "l long, r long, weight double")
    assert rows(linkage.resolve_more(entities, records, more, 5.0)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 1), (7, 1)]
