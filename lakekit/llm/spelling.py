"""Groups of spelling variants by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A word
contributes two disjoint chunks, its halves; a near word that is as long or one shorter contributes
its positional grams of those lengths. One edit leaves a chunk whole, and the near word holds it
with a shift of at most one: the first chunk where it was, the second moved by the difference in
length. So words meet by an equi-join on chunk and gram, and what meets is verified.

A chunk that very many words share is not joined as it is. Its words are cut further: the half in
which the edit must lie is halved again, until few enough words meet or one place is left, where the
alphabet bounds them. Nothing is dropped, and every near pair comes out once, through the chunk in
front of or behind the first place at which the two words differ.

Null and empty texts have no words; an empty table gives an empty result. Repeated rows count as
often as they occur. Ties are broken by the order of code points. Columns other than the id and the
text are not looked at. Long texts and long words are one row each and need no special care.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path

# Fixed value: letters of words.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Comparisons of one chunk in one task; chunks with more are cut further.
MEETINGS = 2_000_000
KEY = ["length", "front", "back", "chunk"]


def count_words(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, text_col: str = "text", change: Callable[[Column], Column] | None = None
) -> DataFrame:
    """`(word, n)`: runs of letters with A-Z lower-cased, and how often they occur.

    `change` may rewrite a run, with the other columns of `docs` at hand. Counts are made before rows move.
    """
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    cut = docs.withColumn("_run", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))))
    word = change(F.col("_run")) if change else F.col("_run")
    words = cut.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` of (word, n, length) with the window's `front` and `back`, for both halves of that window.

    `length` is that of the word which contributes chunks; the same places of another word are its grams.
    """
    middle = F.expr("front + (length - front - back) div 2").cast("int")
    first = F.struct(middle.alias("front"), "back")
    second = F.struct("front", (F.col("length") - middle).alias("back"))
    halves = rows.select("word", "n", "length", F.explode(F.array(first, second)).alias("h")).select("word", "n", "length", "h.*")
    return halves.withColumn("chunk", F.expr("concat(left(word, front), right(word, back))"))


def _near(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified pairs of rows that share a chunk; equally long words are taken in one order."""
    left = chunks.select(*KEY, F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = grams.select(*KEY, F.col("word").alias("b"), F.col("n").alias("b_n"))
    # the pair belongs to the window in which its words differ first
    here = F.expr("left(a, length - back) <> left(b, length - back)")
    order = (F.char_length("b") < F.col("length")) | (F.col("a") < F.col("b"))
    return left.join(right, KEY).filter(order & here & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, folder: str, meetings: int = MEETINGS) -> DataFrame:
    """`(a, a_n, b, b_n)`: every pair of near words of `(word, n)` once; `b` is as long as `a` or one shorter.

    `words` must be stored and hold every word once; steps are stored in `folder`.
    """
    whole = words.select("word", "n", F.char_length("word").alias("length"), F.lit(0).alias("front"), F.lit(0).alias("back"))
    chunks = _keyed(whole)
    partners = F.explode(F.array(F.col("length"), F.col("length") + 1))
    grams = _keyed(whole.withColumn("length", partners))
    found: list[DataFrame] = []
    while True:
        step = f"{folder}/{len(found)}"
        sides = chunks.select(*KEY, F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(
            grams.select(*KEY, F.lit(0).alias("c"), F.lit(1).alias("g"))
        )
        sizes = sides.groupBy(*KEY).agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
        divisible = F.col("length") - F.col("front") - F.col("back") > 1
        crowded = materialise(sizes.filter(divisible & (F.col("c") * F.col("g") > meetings)).select(*KEY), f"{step}-crowded")
        if crowded.isEmpty():
            return _union(found + [_near(chunks, grams)])
        found.append(_near(chunks.join(crowded, KEY, "left_anti"), grams.join(crowded, KEY, "left_anti")))
        chunks = materialise(_keyed(chunks.join(crowded, KEY, "left_semi")), f"{step}-chunks")
        grams = materialise(_keyed(grams.join(crowded, KEY, "left_semi")), f"{step}-grams")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """`(word, root)` of `(word, form)`: forms followed to the last, by doubling; a form occurs at least
    twice as often as its word, so a path is short and never closes."""
    spark = forms.sparkSession
    path = scratch_path(spark, "roots")
    now = materialise(forms.select("word", F.col("form").alias("root")), path)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left")
        step = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, path = path, scratch_path(spark, "roots")
        stored = materialise(step, path)
        delete_path(spark, last)
        now = stored.select("word", "root")
        if stored.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, meetings: int = MEETINGS) -> DataFrame:
    """Every word of `(word, n)` with `n_near`, and the `form`, `form_n` and `root` that it belongs to.

    A word's form is its near word of largest n (ties: smallest in code-point order) if it occurs at
    least twice as often, else null; the root is the last of the forms that follow from the word, the
    word itself if it has none.
    """
    spark = words.sparkSession
    folder = scratch_path(spark, "spelling")
    words = materialise(words.select("word", "n"), f"{folder}/words")
    pairs = near_pairs(words, folder, meetings)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    )
    best = F.min(F.struct(-F.col("near_n"), F.col("near").alias("form"))).alias("best")
    known = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = -F.col("best.col1") >= 2 * F.col("n")
    out = words.join(known, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"),
        F.when(taken, -F.col("best.col1")).alias("form_n"),
    )
    out = materialise(out, scratch_path(spark, "variants"))
    delete_path(spark, folder)
    roots = _roots(out.filter(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
