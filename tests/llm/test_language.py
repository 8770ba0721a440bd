import zlib

import numpy as np
from cases import DOCS, empty_docs, hard_docs
from pyspark.sql import functions as F

from lakekit.llm import language, queries


def brute_vector(text):
    """Letter by letter: rotated vectors multiplied, and added up."""
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    clean = f" {' '.join(clean.split())} "
    codes = [0 if c == " " else ord(c) for c in clean]
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(language.letter_vector(a), 2) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c)
    return total


def test_against_brute_force(spark):
    docs = hard_docs(spark).filter("n_chars is null or n_chars < 3000")
    profiles = language.learn(docs)
    assert profiles.labels == ["en", "fr"]
    rows = docs.select("text", "lang").collect()
    for label, vector in zip(profiles.labels, profiles.vectors):
        bundles = [(brute_vector(t), t) for t, lang in rows if lang == label]
        total = sum(v / max(len(language.grams_of(t)), 1) for v, t in bundles)
        assert np.dot(total / np.linalg.norm(total), vector) > 0.99999
    out = language.identify(docs.select("doc_id", "text"), profiles).collect()
    assert len(out) == docs.count()
    for r in out:
        v = brute_vector(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cosines = profiles.vectors @ (v / np.linalg.norm(v))
            assert abs(r["score"] - max(cosines.max(), 0)) < 1e-4
            assert cosines[profiles.labels.index(r["lang_pred"])] > cosines.max() - 1e-4


def test_empty_unlabelled_and_clashing(spark):
    docs = hard_docs(spark).withColumnsRenamed({"source": "lang_pred"})
    none = language.learn(docs.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(empty_docs(spark), none).count() == 0
    assert language.learn(empty_docs(spark)).labels == []


def test_row_order_does_not_matter(spark):
    docs = hard_docs(spark)
    a, b = language.learn(docs.repartition(1)), language.learn(docs.repartition(7))
    assert np.array_equal(a.vectors, b.vectors)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op3_hyper_language(spark, folder)
    truth = queries.documents(spark, folder).select(F.col("doc_id").alias("id"), "lang")
    rows = out.join(truth, out["doc_id"] == truth["id"]).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang"] == r["lang_pred"] for r in held)
    assert right >= 0.97 * len(held), (right, len(held))


def test_null_ids_are_in_no_part(spark):
    docs = spark.createDataFrame([(None, "text", "en", None, 0)], DOCS)
    assert docs.select(language.remainder(F.col("doc_id"))).first()[0] is None


def test_texts_in_wide_alphabets_take_bounded_memory(spark, monkeypatch):
    """Hundreds of thousands of distinct letters in one text, with and without the shared table: same answers."""
    wide = "".join(chr(0x4E00 + (i * 7919) % 20000) + chr(0xAC00 + (i * 104729) % 11000) for i in range(150_000))
    rows = [(1, "the house and the tree", "en"), (2, "das haus und der baum", "de"), (3, wide[:2000], "xx"), (4, wide, None), (5, "the tree", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    profiles = language.learn(docs)
    assert len(np.unique([hash(wide[i : i + 3]) for i in range(0, len(wide), 1)])) > 250_000
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in language.identify(docs, profiles).collect()}
    assert got[4][0] == "xx" and got[5][0] == "en"
    peak = 0
    whole = language.gram_vectors

    def watched(grams):
        nonlocal peak
        peak = max(peak, len(grams))
        return whole(grams)

    monkeypatch.setattr(language, "gram_vectors", watched)
    (i, grams, counts), = language._counted([wide])
    language._bundled(grams, counts)
    assert len(grams) > 250_000 and peak <= 4096
