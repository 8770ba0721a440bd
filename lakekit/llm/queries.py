"""The named queries of this subpackage: thin bindings of its operators to the test tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import ship
from . import bpe, conversation_trie, embedding_dedup, fingerprints, language, licenses, mixing, ngram_join, oracle, quality_model, quality_rules, repeats, secrets, spelling

SQL = oracle.SQL


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def rank_file(path: str | None = None) -> bytes:
    """The bounded rank file that the encoder is given; the path is a parameter."""
    return Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


def op1_anchor_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, folder))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", kept)


def op2_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The scorer's probability and verdict for every document."""
    docs = documents(spark, folder).select("doc_id", "text")
    scored = quality_model.classify(docs)
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= quality_model.THRESHOLD).alias("kept"))


def op3_hyper_language(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the documents of two parts of three; the third is held out. A null id is in none."""
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    part = language.remainder(F.col("doc_id"))
    profiles = language.learn(docs.filter(part != 1))
    named = language.identify(docs.select("doc_id", "text"), profiles)
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    return named.select("doc_id", held_out, "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return bpe.encoded_digests(docs, rank_file(), public_tokenizers.PATTERN)


def op5_license_join(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder).select("doc_id", "text")).drop("blocks")


def op6_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One scan with a ledger of its own; the base kinds come first among the rules."""
    docs = documents(spark, folder).select("doc_id", "text")
    ledger = secrets.new_ledger(spark)
    secrets.scan(docs, ledger)
    found = secrets.by_path(docs, ledger, ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op7_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = quality_rules.clean(documents(spark, folder).select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return cleaned.select("doc_id", *counts, "base_failed", "kept")


def op8_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed(documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op10_prefix_trees(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(documents(spark, folder).select("doc_id", "text"), size=3, percent=90)


def op11_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edited(documents(spark, folder).select("doc_id", "text"))


def op12_double_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Trie over conversations that begin with turns of the first one of their five."""
    ship(spark)
    own = conversation_trie.sequences(spark.read.parquet(f"{folder}/conversations.parquet"))
    own = materialise(own, scratch_path(spark, "sequences"))
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rebuilt = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), borrowed)
    turns = F.concat(head, F.slice("turns", borrowed + 1, F.size("turns")))
    return conversation_trie.nodes(rebuilt.select("conv_id", turns.alias("turns")))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose number with their document's id is divisible by 97 lose one letter first."""
    number = lambda run: F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))

    def damaged(run: Column) -> Column:
        place = (number(run) % F.char_length(run)).cast("int")
        return F.when(number(run) % 97 == 0, F.concat(F.left(run, place), F.substring(run, place + 2, F.char_length(run)))).otherwise(run)

    words = spelling.count_words(documents(spark, folder).select("doc_id", "text"), change=damaged)
    return spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {
    "op1_anchor_repeats": op1_anchor_repeats,
    "op2_weak_labels": op2_weak_labels,
    "op3_hyper_language": op3_hyper_language,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_join": op5_license_join,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_line_rules": op7_line_rules,
    "op8_fair_mix": op8_fair_mix,
    "op9_projection_forest": op9_projection_forest,
    "op10_prefix_trees": op10_prefix_trees,
    "op11_bottom_k": op11_bottom_k,
    "op12_double_arrays": op12_double_arrays,
    "op13_spelling_variants": op13_spelling_variants,
}
