import re
import zlib
from collections import Counter

import pytest
from cases import empty_docs, hard_docs
from pyspark.sql import functions as F

from lakekit.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(count):
    """Rows of the contract for a word count, by comparing all words with all."""
    best, out = {}, []
    for w, n in count.items():
        friends = [v for v in count if v != w and near(w, v)]
        top = min(friends, key=lambda v: (-count[v], v), default=None)
        best[w] = top if top and count[top] >= 2 * n else None
        out.append((w, n, len(friends)))
    rows = []
    for w, n, many in out:
        root = w
        while best[root]:
            root = best[root]
        rows.append((w, n, many, best[w], count[best[w]] if best[w] else None, root))
    return sorted(rows)


def counted(docs):
    count = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def query(spark, docs, root):
    docs.write.parquet(f"{root}/documents.parquet")
    return queries.op13_spelling_variants(spark, root)


def test_query_on_hard_rows(spark, root):
    docs = hard_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clash = docs.withColumns({c: F.lit("x") for c in ("word", "n", "_run", "chunk", "length")})
    assert got(query(spark, clash, root)) == brute(counted(rows))


def test_empty_tables(spark, root):
    assert got(query(spark, empty_docs(spark), root)) == []
    nulls = spark.createDataFrame([(None, None), (1, ""), (1, "..")], "doc_id bigint, text string")
    assert got(query(spark, nulls, root + "-nulls")) == []


@pytest.mark.parametrize("meetings", [2_000_000, 4])
def test_variants_with_crowded_chunks(spark, meetings):
    """Words that share halves, letters in a row, one letter in front or behind, wide letters, a very long word, ties."""
    words = {"aaaaa": 9, "aaaaaa": 20, "aaaaaaa": 3, "aaaab": 3, "baaaa": 3, "éaaaa": 4, "éaaaaé": 8, "abcde": 5, "abcdf": 10}
    words |= {"abcdg": 10, "xabcde": 3, "abcdex": 3, "abXcde".lower(): 40, "ÿbcde": 4, "z" * 3000: 3, "z" * 2999: 7}
    words |= {"prefix" + a + b: 3 + i for i, (a, b) in enumerate((x, y) for x in "abcdefg" for y in "abcdefg")}
    words |= {a + b + "suffix": 3 for a in "abcd" for b in "abcd"}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling.variants(df, meetings)) == brute(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"chain" + "x" * i: 3 * 2**i for i in range(12)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling.variants(df)) == brute(words)
