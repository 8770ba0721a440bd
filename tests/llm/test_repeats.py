from collections import Counter

import numpy as np
import pytest
from cases import DOCS, empty_docs, hard_docs, words

from lakekit.llm import packing, repeats


def brute(texts, window):
    """Words and words left of every text."""
    cut = [words(t) for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = {i + j for i in range(len(w) - window + 1) if often[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 6, 3, 2])
def test_against_brute_force(spark, window):
    docs = hard_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], window)))
    out = repeats.remove_repeats(docs, window=window).collect()
    got = sorted((-1 if r[0] is None else r[0], r["n_words"], r["n_removed"], r["kept_text"]) for r in out)
    assert got == expected
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in out)


def test_empty_tables_and_no_words(spark):
    assert repeats.remove_repeats(empty_docs(spark)).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, 0), (1, "", None, None, 0)], DOCS)
    assert [r["n_words"] for r in repeats.remove_repeats(docs).collect()] == [0, 0]


def test_ids_of_any_kind_and_clashing_names(spark):
    docs = hard_docs(spark).selectExpr("cast(doc_id as string) as chunk", "text as body", "lang as bucket", "source as text")
    assert repeats.remove_repeats(docs, "chunk", "body").count() == docs.count()


def test_windows_hash():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for width in (1, 2, 3, 7, 18, 35, 200):
        h = packing.window_hashes(w, width)
        assert len(h) == 201 - width
        assert np.array_equal(packing.window_hashes(w[5:], width), h[5:]) if width <= 195 else True
        one = packing.window_hashes(w[: width], width)
        assert one[0] == h[0]


def test_pack():
    values = np.sort(np.unique(np.random.default_rng(2).integers(0, 2**64 - 1, 5000, dtype=np.uint64)))
    cuts = packing.cuts_by_bucket(values, 6)
    for b in range(64):
        mine = values[cuts[b] : cuts[b + 1]]
        assert ((mine >> np.uint64(58)) == b).all()
        expected = (mine << np.uint64(6)) >> np.uint64(24)
        assert np.array_equal(packing.unpack(packing.pack(mine, 6, 40)), expected)
