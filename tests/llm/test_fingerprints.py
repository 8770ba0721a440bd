import base64
import hashlib
import random

import numpy as np
import pytest
from cases import empty_docs, hard_docs, prose, sha, words
from pyspark.sql import functions as F

from lakekit.llm import fingerprints, queries

BITS = (1 << 64) - 1


def shingles(text):
    each = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words(text)]
    out = set()
    for i in range(max(1, len(each) - 4) if each else 0):
        h = 0
        for w in each[i : i + 5]:
            h = (h * fingerprints.MULTIPLIER + w) & BITS
        h = ((h ^ h >> 32) * fingerprints.SCRAMBLE) & BITS
        out.add(h ^ h >> 29)
    return sorted(out)


def coded(hashes):
    return base64.b64encode(b"".join(h.to_bytes(8, "big") for h in hashes)).decode()


def alike(a, b):
    union = sorted(set(a) | set(b))[:128]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute(rows):
    """The contract over one sorted list; equal ids follow by the MD5 of their text."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (shingles(x)[:128] for x in (t, edited, after))
        out.append((i, len(t), sha(edited), coded(a), coded(b), round(alike(a, b), 12), round(alike(a, c), 12)))
    return sorted(out, key=str)


def got(df):
    found = df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    return sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, found)], key=str)


@pytest.mark.parametrize("bytes_in_range", [24 << 20, 500, 1])
def test_query_on_hard_rows(spark, root, monkeypatch, bytes_in_range):
    """Null and repeated ids, empty texts, clashing names; one range, several, one per row."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", bytes_in_range)
    docs = hard_docs(spark).withColumn("doc_id", F.col("doc_id") * 3 - 40)
    docs.withColumns({c: F.lit("x") for c in ("id", "place", "bucket", "guest", "n", "size", "fingerprint")}).write.parquet(f"{root}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(queries.op11_bottom_k(spark, root)) == brute(rows)


def test_empty_and_single_tables(spark):
    assert got(fingerprints.with_edited(empty_docs(spark))) == []
    for row in [(7, "one two three"), (None, None), (0, "é")]:
        one = spark.createDataFrame([row], "doc_id bigint, text string")
        assert got(fingerprints.with_edited(one)) == brute([row])


def test_masses_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "COPIES", 100)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2000)
    rows = [(5, "the same text again and again")] * 2500 + [(None, "no id but many")] * 150 + [(i, f"text number {i} of some") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(fingerprints.with_edited(docs)) == brute(rows)


def test_estimates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    table = fingerprints._Words()
    a = prose(rng, 4000, vocabulary)
    b = " ".join(a.split()[:2000]) + " " + prose(rng, 2000, vocabulary)
    x, y = (fingerprints.sketch(t.encode(), table) for t in (a, b))
    p, q = set(shingles(a)), set(shingles(b))
    assert abs(fingerprints.resemblance(x, y) - len(p & q) / len(p | q)) < 0.13
    assert abs(fingerprints.containment(x, y) - len(p & q) / len(p)) < 0.25
    assert abs(fingerprints.distinct(x) / len(p) - 1) < 0.3
    assert fingerprints.containment(x[:0], y) == 1.0 and fingerprints.distinct(x[:0]) == 0


def test_parts_merge_into_the_whole(spark):
    rng = random.Random(4)
    parts, whole = [], {}
    for i in range(400):
        key = None if i % 5 == 0 else i % 3
        text = prose(rng, rng.randint(0, 40), [f"w{j}" for j in range(60)])
        parts.append((i, key, text))
        whole.setdefault(key, set()).update(shingles(text))
    df = spark.createDataFrame(parts, "doc_id bigint, owner bigint, text string").repartition(4)
    done = fingerprints.merge_parts(fingerprints.sketch_texts(df).join(df, "doc_id"), ["owner"])
    assert {r["owner"]: r["fingerprint"] for r in done.collect()} == {k: coded(sorted(v)[:128]) for k, v in whole.items()}
    assert np.array_equal(fingerprints.decode(fingerprints.encode(np.array([1, BITS], dtype=np.uint64))), [1, BITS])
