import os
import random
import re
import time

import numpy as np
import pytest
from cases import DOCS, empty_docs, hard_docs, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st

from lakekit.llm import ngram_join
from lakekit.session import shared_root


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(text, size):
    w = words(low(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """`(id, set size, component)` of `(id, text)` rows."""
    sets = [grams(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        known = [k for k in (key, least.get(find(i))) if k is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((-1 if k is None else k), len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r[0] is None else r[0], r["n_shingles"], r["component_id"]) for r in df.collect())


def family(rng, n, edits):
    """Near copies with a few words changed, and unrelated texts."""
    vocabulary = [f"v{i}" for i in range(200)]
    base = prose(rng, 120, vocabulary).split(" ")
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out + [prose(rng, rng.randint(0, 50), vocabulary) for _ in range(n)]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    docs = hard_docs(spark)
    texts = family(rng, 25, 4) + family(rng, 15, 9)
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(texts)], DOCS))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(ngram_join.components(docs, size=size, percent=percent)) == brute(rows, size, percent)


def test_blocks_of_a_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", (600, 600))
    texts = family(random.Random(9), 30, 5)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    assert got(ngram_join.components(docs, size=3, percent=80)) == brute(list(enumerate(texts)), 3, 80)


def test_empty_and_clashing(spark):
    assert ngram_join.components(empty_docs(spark)).count() == 0
    docs = hard_docs(spark).selectExpr("doc_id as root", "text as n", "lang as set_key", "source as place")
    assert ngram_join.components(docs, "root", "n").count() == docs.count()


def test_keep_one(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words are here now"), (2, "other words are here now"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    kept = ngram_join.keep_one(docs, size=3, percent=90)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_keep_one_without_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k"), (None, "g h i j k"), (None, "G h i j k"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    kept = ngram_join.keep_one(docs, size=3, percent=90).collect()
    assert sorted(((r["doc_id"] or 0), (r["text"] or "").lower()) for r in kept) == [(0, ""), (0, "g h i j k"), (1, "a b c d e f")]


def meet(a, b, percent):
    """Whether two sets share as many keys of a class as both need there."""
    (ours, our_need), (theirs, their_need) = ngram_join.keys_of(a, percent), ngram_join.keys_of(b, percent)
    for bit in (0, 1):
        shared = len({int(k) for k in ours if k & 1 == bit} & {int(k) for k in theirs if k & 1 == bit})
        needs = [need >> 1 & 255 if need & 1 == bit else need >> 9 for need in (our_need, their_need)]
        if shared and shared >= max(needs):
            return True
    return False


SETS = st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=25)


@settings(max_examples=300, deadline=None)
@given(SETS, st.sampled_from([50, 80, 90, 100]))
def test_trie_finds_all_similar(sets, percent):
    distinct = sorted({tuple(sorted(s)) for s in sets})
    arrays = [np.array(s, dtype=np.uint64) for s in distinct]
    trie = ngram_join.Trie(arrays)
    for i, a in enumerate(distinct):
        near = {j for j, b in enumerate(distinct) if 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))}
        assert set(trie.similar(arrays[i], percent, lambda j: False)) == near
        for j in near:
            assert meet(arrays[i], arrays[j], percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_sizes_at_the_edge_meet(percent):
    """All pairs of sizes that may be similar, with the least overlap, placed last in the order."""
    for n in range(1, 220):
        for m in range(n, n * 100 // percent + 1):
            need = ngram_join.required(n, m, percent)
            if need > n:
                continue
            common = np.arange(10_000, 10_000 + need, dtype=np.uint64)
            a = np.concatenate((np.arange(n - need, dtype=np.uint64), common))
            b = np.concatenate((np.arange(5_000, 5_000 + m - need, dtype=np.uint64), common))
            assert meet(a, b, percent), (n, m)


@pytest.mark.parametrize("tokens", [None, 600])
def test_all_pairs_against_brute_force(spark, monkeypatch, tokens):
    """Every similar pair of distinct sets once, also between sets that others connect already."""
    if tokens:
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", (tokens, tokens))
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [prose(rng, 200, vocabulary).split(" ") for _ in range(3)]
    rows = []
    for words_of_base in base:
        for i in range(12):
            near = list(words_of_base)
            near[10 * i + 3] = f"changed{i}"
            rows.append((len(rows), " ".join(near)))
    rows += [(100 + i, t) for i, t in rows[:5]] + [(200, None), (201, "")]
    sets = {}
    for i, t in rows:
        if grams(t, 5):
            sets.setdefault(frozenset(grams(t, 5)), i)
    expected = sorted(
        (i, j) for a, i in sets.items() for b, j in sets.items() if i < j and 100 * len(a & b) >= 80 * len(a | b)
    )
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    pairs = ngram_join.similar_pairs(docs, size=5, percent=80).collect()
    assert sorted(tuple(sorted((r["src_id"], r["dst_id"]))) for r in pairs) == expected
    assert len(expected) > 150


def copies(spark, groups, each):
    """Near copies: every text with a last word of its own."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [prose(rng, 300, vocabulary) for _ in range(groups)]
    rows = [(g * each + i, f"{t} last{i}") for g, t in enumerate(base) for i in range(each)]
    return rows, spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)


def heads_of(docs):
    return ngram_join._heads(docs, "doc_id", "text", 5, 80, ngram_join.sketch(docs, "text", 5))


def test_keys_of_near_copies_are_told_once_per_unit(spark):
    rows, docs = copies(spark, 4, 40)
    heads = heads_of(docs)
    met = ngram_join.shared_keys(heads)
    keys = heads.selectExpr("sum(size(head)) AS n").first()["n"]
    assert keys > 50 * len(rows) and met.count() < keys / 10


@given(st.sets(st.tuples(st.integers(-4, 4), st.integers(-6, 6)), max_size=40))
def test_units_cover_every_key_of_their_documents(pairs):
    ordered = sorted(pairs)
    table = ngram_join.units_of(*(np.array([p[i] for p in ordered], dtype=np.int64) for i in (0, 1))).to_pylist()
    unit = {r["doc"]: r["unit"] for r in table if r["token"] is None}
    told = [(r["token"], r["unit"], r["several"]) for r in table if r["token"] is not None]
    assert set(unit) == {d for _, d in pairs} and len(table) == len(unit) + len(told)
    assert sorted(told) == sorted(
        {(k, unit[d], sum(j == k and unit[e] == unit[d] for j, e in pairs) > 1) for k, d in pairs}
    )


def test_crowded_smallest_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 3)
    rows, docs = copies(spark, 3, 25)
    docs = docs.unionByName(hard_docs(spark)).repartition(3)
    most = ngram_join.in_chunks(heads_of(docs)).groupBy("chunk").count().selectExpr("max(count)").first()[0]
    assert most < 25
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(ngram_join.components(docs, size=5, percent=80)) == brute(rows, 5, 80)


def test_keys_and_shuffles_do_not_stay(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    folder = f"{shared_root(spark)}/lakekit".removeprefix("file:")
    os.makedirs(folder, exist_ok=True)

    _, docs = copies(spark, 3, 10)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, there, files = spark.conf.get(cleanup, None), set(os.listdir(folder)), shuffled()
    ngram_join._members(docs, "doc_id", "text", 5, 80)
    left = {re.sub("-[0-9a-f]{32}$", "", name) for name in set(os.listdir(folder)) - there}
    assert "ngram-links" in left and not left & {"ngram-heads", "ngram-postings"}
    assert spark.conf.get(cleanup, None) == held
    for _ in range(50):
        if not shuffled() - files:
            break
        time.sleep(0.2)
    assert not shuffled() - files


@pytest.mark.parametrize("seed, percent, edits", [(1, 80, 9), (2, 80, 16), (3, 70, 25)])
def test_wide_places_against_brute_force(spark, monkeypatch, seed, percent, edits):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", (600, 600))
    monkeypatch.setattr(ngram_join, "WIDE", 2)
    texts = family(random.Random(seed), 60, edits)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    assert got(ngram_join.components(docs, size=3, percent=percent)) == brute(list(enumerate(texts)), 3, percent)


def test_texts_of_a_large_group_move_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", (2_000, 2_000))
    folder = f"{shared_root(spark)}/lakekit".removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    rows, docs = copies(spark, 1, 200)
    there = set(os.listdir(folder))
    assert {r[2] for r in got(ngram_join.components(docs, size=5, percent=80))} == {0}
    cells = [spark.read.parquet(f"{folder}/{name}") for name in set(os.listdir(folder)) - there if name.startswith("ngram-cells")]
    # the group fills some thirty blocks
    assert sum(c.selectExpr("coalesce(sum(size(cells)), 0)").first()[0] for c in cells) < 4 * len(rows)


@pytest.mark.parametrize("outside", [0, 9, 45])
def test_rest_cells_meet_all_that_is_not_connected(spark, outside):
    """One large component and `outside` sets in small ones; what shares a block or meets the first block is compared before."""
    rng = random.Random(outside)
    key = lambda i: bytes([i])
    sets = [(key(i), key(i), rng.randint(0, 6), 5, 7, 600, 10) for i in range(60)]
    dealt = spark.createDataFrame(sets, "text_key binary, set_key binary, block int, place bigint, blocks int, total bigint, n bigint")
    root = {key(i): key(0) if i < 60 - outside else key(i - i % 3) for i in range(60)}
    links = spark.createDataFrame([(k, r) for k, r in root.items() if k != r], "src binary, dst binary")
    cells = ngram_join._rest_cells(dealt, links, 30).collect()
    there = {}
    for c in cells:
        there.setdefault(bytes(c["set_key"]), set()).add((c["low"], c["high"], c["block"]))
    assert bool(there) == bool(outside)
    find = {i: min(j for j in root if root[j] == root[i]) for i in root}
    for a, _, p, *_ in sets:
        for b, _, q, *_ in sets:
            if p and q and p != q and find[a] != find[b]:
                assert any(x[:2] == y[:2] and x[2] != y[2] for x in there[a] for y in there[b]), (a, b)
