import numpy as np

from lakekit.llm import embedding_dedup, queries

KIND = "vec_id bigint, embedding array<float>, label int, extra string"


def brute(rows, least=0.93):
    """`id -> (links, component)` over all pairs, in doubles; ids are distinct."""
    good = []
    for key, v, label in rows:
        usable = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=np.float64) if usable else None)
    links, up = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            b, _, lb = rows[j]
            x, y = good[i], good[j]
            if x is None or y is None or la != lb or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (links[k], find(k)) for k, _, _ in rows}


def clusters(seed, n, dimensions=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dimensions))
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.standard_normal(dimensions) * rng.choice([0.05, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


def hard():
    nan, inf = float("nan"), float("inf")
    rows = clusters(1, 300)
    one = rows[0][1]
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3, one, one, [-x for x in one]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    return rows + [(2000, one, None), (2001, one, 1), (2002, one, rows[0][2])]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3)


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_one_leaf_is_exact(spark):
    rows = hard()
    out = embedding_dedup.near_duplicates(table(spark, rows))
    assert result(out) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


def test_trees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", (16, 16))
    rows = hard()
    got, expected = result(embedding_dedup.near_duplicates(table(spark, rows))), brute(rows)
    assert all(got[k][0] <= expected[k][0] for k in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in expected.values())


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    out = embedding_dedup.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in out if r["n_links"]) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert [(r["vec_id"], r["component_id"], r["kept"]) for r in out if not r["n_links"]] == [(None, None, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_recall_on_the_given_vectors(spark, tmp_path, monkeypatch):
    """The given vectors, most of which have noisy copies here, since they have no links by themselves."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 60)
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rng, rows = np.random.default_rng(4), []
    for r in given:
        v = np.array(r["embedding"])
        for k in range(int(rng.integers(1, 5))):
            noise = rng.standard_normal(len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * rng.choice([0.05, 0.2, 0.3, 0.5])
            rows.append((r["vec_id"] * 10 + k, [float(np.float32(x)) for x in v + noise * (k > 0)], r["label"]))
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, expected = result(queries.op9_projection_forest(spark, str(tmp_path))), brute(rows)
    assert all(got[k][0] <= expected[k][0] for k in got)
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in expected.values())
    assert all_links > 300 and found >= 0.95 * all_links
