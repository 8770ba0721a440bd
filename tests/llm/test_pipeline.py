import base64

import public_tokenizers
import pytest
import tiktoken
from cases import empty_docs, hard_docs
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_components
from test_secrets import brute as brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is not None, i))


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    hard = hard_docs(spark).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(hard)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    good = stages[names[0]](spark, docs, folder)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()

    one = stages[names[1]](spark, good, folder)
    rows = [(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").distinct().collect()]
    expected = sorted(i for i, _, c in brute_components(rows, 5, 80) if i == c)
    assert ids(one) == expected and one.columns == docs.columns

    safe = stages[names[2]](spark, one, folder)
    assert safe.columns == docs.columns and ids(safe) == expected
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in safe.collect():
        assert brute_spans(r["text"]) == []
        if not brute_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        else:
            assert "[REDACTED]" in r["text"] and r["n_chars"] == len(r["text"])

    mix = stages[names[3]](spark, safe, folder)
    assert mix.columns == docs.columns
    assert set(ids(mix)) <= set(expected) and max(ids(mix).count(i) for i in expected) <= 2

    out = stages[names[4]](spark, mix, folder).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, corpus_pipeline.rank_file().splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert sorted(r["doc_id"] for r in out) == ids(mix)
    assert all(r["intact"] and r["token_ids"] == library.encode_ordinary(texts[r["doc_id"]]) for r in out)


def test_hard_rows_keep_their_columns(spark):
    """Null ids, repeated rows and columns with the names that operators use inside go through all stages."""
    clash = [f"_own{i}" for i in range(6)] + ["_plan", "_key", "_times", "_copy", "_blob", "_spans", "_kept", "_md5", "_text_key", "_quality"]
    docs = hard_docs(spark).select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.md5("text"), F.lit("none"))).alias(c) for c in clash])
    texts = {r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == clash, name
        for r in docs.collect():
            assert len({r[c].split(" of ")[1] for c in clash}) == 1 and all(r[c].split(" of ")[0] == c for c in clash), name
            assert r["text"] in texts or "[REDACTED]" in r["text"], name
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert coded.count() == docs.count() > 10 and coded.filter("not intact").count() == 0


def test_empty_table(spark):
    docs = empty_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
