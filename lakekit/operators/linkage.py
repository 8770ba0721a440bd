"""Record linkage: name normalisation, blocking, candidate pairs, comparison, scoring, clusters.

Candidates are generated so that their number follows the number of distinct values and not the
square of a block: equal values are linked to one representative, and near values are found by an
equi-join on shared deletion variants, which is exact for the given edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell
from .graph import connected_components, merge_components
from .skew import lookup_join

# Words that are not part of a name.
TITLES = ["MR", "MRS", "MS", "MISS", "DR", "HON", "REV", "PROF", "SIR"]
SUFFIXES = ["JR", "SR", "II", "III", "IV", "V", "ESQ", "MD", "PHD", "CPA", "INC", "LLC", "LTD", "CORP", "CO"]
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUY"


def clean_name(name: Column) -> Column:
    """Upper case, no accents, punctuation to spaces but for an apostrophe inside a word, single spaces."""
    plain = F.translate(F.upper(name), ACCENTED + "’", PLAIN + "'")
    words = F.regexp_replace(plain, r"[^A-Z0-9']+|(?<![A-Z0-9])'+|'+(?![A-Z0-9])", " ")
    return F.trim(F.regexp_replace(words, r" +", " "))


def _leading(words: Column, listed: Sequence[str]) -> Column:
    """How many words at the front are in the list; one word always stays."""
    other = F.array_position(F.transform(words, lambda w: ~w.isin(list(listed))), True)
    count = F.when(other > 0, other - 1).otherwise(F.size(words)).cast("int")
    return F.greatest(F.least(count, F.size(words) - 1), F.lit(0))


def _front(words: Column, count: Column) -> Column:
    return F.slice(words, F.lit(1), count)


def _back(words: Column, count: Column) -> Column:
    """All words but the first `count`."""
    return F.slice(words, count + 1, F.greatest(F.size(words) - count, F.lit(0)))


def normalise_names(df: DataFrame, col: str) -> DataFrame:
    """Add `name_clean, name_title, name_first, name_last, name_suffix`.

    Parts behind a comma that hold suffixes only are taken off first; of what is left, `LAST, FIRST`
    is turned round. Titles are taken from the front and suffixes from the end, all of them, also
    from a last name that stands before a comma; several are joined by spaces. A name of one word is
    a last name.
    """
    raw = F.col(col)
    parts = F.transform(F.split(raw, ","), lambda p: F.filter(F.split(clean_name(p), " "), lambda w: w != ""))
    only_suffixes = lambda p: F.forall(p, lambda w: w.isin(SUFFIXES))
    ending = F.array_position(F.transform(F.reverse("_p"), lambda p: ~only_suffixes(p)), True)
    loose = F.least(F.when(ending > 0, ending - 1).otherwise(F.size("_p")).cast("int"), F.size("_p") - 1)
    none = F.array().cast("array<string>")
    turned = F.size("_main") > 1
    steps = (
        df.withColumn("name_clean", clean_name(raw))
        .withColumn("_p", F.filter(F.coalesce(parts, F.array().cast("array<array<string>>")), lambda p: F.size(p) > 0))
        .withColumn("_n", F.greatest(loose, F.lit(0)))
        .withColumn("_main", F.slice("_p", F.lit(1), F.size("_p") - F.col("_n")))
        .withColumn("_tail", F.flatten(_back(F.col("_p"), F.size("_p") - F.col("_n"))))
        .withColumn("_head", F.coalesce(F.try_element_at("_main", F.lit(1)), none))
        # of a last name before a comma
        .withColumn("_t", F.when(turned, _leading(F.col("_head"), TITLES)).otherwise(0))
        .withColumn("_titles", _front(F.col("_head"), F.col("_t")))
        .withColumn("_head", _back(F.col("_head"), F.col("_t")))
        .withColumn("_s", F.when(turned, _leading(F.reverse("_head"), SUFFIXES)).otherwise(0))
        .withColumn("_tail", F.concat(_back(F.col("_head"), F.size("_head") - F.col("_s")), F.col("_tail")))
        .withColumn("_head", _front(F.col("_head"), F.size("_head") - F.col("_s")))
        .withColumn("_w", F.concat(F.flatten(_back(F.col("_main"), F.lit(1))), F.col("_head")))
        # of the whole name
        .withColumn("_t", _leading(F.col("_w"), TITLES))
        .withColumn("_titles", F.concat(_front(F.col("_w"), F.col("_t")), F.col("_titles")))
        .withColumn("_w", _back(F.col("_w"), F.col("_t")))
        .withColumn("_s", _leading(F.reverse("_w"), SUFFIXES))
        .withColumn("_tail", F.concat(_back(F.col("_w"), F.size("_w") - F.col("_s")), F.col("_tail")))
        .withColumn("_w", _front(F.col("_w"), F.size("_w") - F.col("_s")))
    )
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    return (
        steps.withColumn("name_title", joined("_titles"))
        .withColumn("name_suffix", joined("_tail"))
        .withColumn("name_first", F.when(F.size("_w") > 1, F.col("_w")[0]))
        .withColumn("name_last", F.when(F.size("_w") > 0, F.try_element_at("_w", F.lit(-1))))
        .drop("_p", "_n", "_main", "_tail", "_head", "_t", "_titles", "_s", "_w")
    )


# Rules of the phonetic code, applied in this order to the letters A-Z of a name: silent letters at
# the ends, groups of letters that sound as one, soft and hard letters, voiced and voiceless ones.
# 0 stands for TH and X for SH. No rule looks behind or ahead, so SQL engines can apply them too.
SOUND_RULES = (
    ("^[KGP]N", "N"), ("^WR", "R"), ("^PS", "S"), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("GN$", "N"),
    ("SCH", "SK"), ("TCH", "1"), ("CH|SH", "1"), ("[ST]I([AO])", "1$1"), ("X", "KS"), ("1", "X"),
    ("PH", "F"), ("GHT", "T"), ("GH", ""), ("TH", "0"), ("DG([EIY])", "J$1"), ("G([EIY])", "J$1"), ("C([EIY])", "S$1"),
    ("CK|[CQG]", "K"), ("Z", "S"), ("V", "F"), ("D", "T"), ("P", "B"), ("^[AEIOUY]+", "A"),
)
# silent inside a word, or vowels
DROPPED = "[AEIOUYWH]"
DOUBLED = "BFJKLMNRSTX0"


def phonetic(col: Column) -> Column:
    """Code of how a name sounds: its first letter, vowels as A, then its consonants by `SOUND_RULES`, single.

    NULL for a text without a letter. Names that differ in vowels, doubled or silent letters, or in
    ways to write a sound get one code.
    """
    code = F.regexp_replace(clean_name(col.cast("string")), "[^A-Z]", "")
    for pattern, sound in SOUND_RULES:
        code = F.regexp_replace(code, pattern, sound)
    code = F.concat(F.substring(code, 1, 1), F.regexp_replace(F.substring(code, 2, 1 << 20), DROPPED, ""))
    for letter in DOUBLED:
        code = F.regexp_replace(code, f"{letter}{letter}+", letter)
    return F.when(code != "", code)


def cell_keys(lon: Column, lat: Column, res: float) -> Column:
    """Grid cells, as texts, that a place shares with every place at most `res / 2` away on either axis; one to four.

    NULL without a place.
    """
    half = res / 2
    corners = [cell(lon + dx, lat + dy, res).cast("string") for dx in (-half, half) for dy in (-half, half)]
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array_sort(F.array_distinct(F.array(*corners))))


def prefix(col: Column, n: int) -> Column:
    return F.when(F.length(col) >= n, F.substring(col, 1, n))


def blocking_keys(df: DataFrame, id_col: str, rules: Mapping[str, Column]) -> DataFrame:
    """`(id, rule, block)`: one row per record and rule whose key is not NULL; a rule may give an array of keys."""
    kinds = df.select(*[c.alias(n) for n, c in rules.items()]).schema
    many = {n: c if kinds[n].dataType.typeName() == "array" else F.array(c) for n, c in rules.items()}

    def of(rule: str, blocks: Column) -> Column:
        return F.transform(blocks.cast("array<string>"), lambda block: F.struct(F.lit(rule).alias("rule"), block.alias("block")))

    of_rule = [of(n, c) for n, c in many.items()]
    none = F.array().cast("array<struct<rule:string,block:string>>")
    keys = F.flatten(F.array(*[F.coalesce(k, none) for k in of_rule]))
    return (
        df.select(F.col(id_col).alias("id"), F.explode(keys).alias("k"))
        .select("id", "k.rule", "k.block")
        .filter(F.col("block").isNotNull())
    )


def _variants(value: Column, max_edits: int) -> Column:
    """Hashes of `value` and of all texts that up to `max_edits` deletions make of it.

    The texts themselves are never gathered: a row holds eight bytes for each.
    """

    def hashes(text: Column, begin: Column, left: int) -> Column:
        own = F.array(F.xxhash64(text))
        if not left:
            return own
        places = F.when(begin <= F.length(text), F.sequence(begin, F.length(text))).otherwise(F.array().cast("array<int>"))

        def without(i: Column) -> Column:
            shorter = F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
            return hashes(shorter, i, left - 1)

        return F.concat(own, F.flatten(F.transform(places, without)))

    return F.array_distinct(hashes(value, F.lit(1), max_edits))


def candidate_pairs(keys: DataFrame, records: DataFrame, field: str, max_edits: int = 1) -> DataFrame:
    """`(l, r, kind)` with `l < r`, each pair once across all blocking rules.

    Within a block, records of one value of `field` are linked to the smallest id of that value
    (`same`), and the smallest ids of two values at most `max_edits` apart are linked (`near`). So
    two records of a block whose values are that close are always connected through the pairs,
    and a block of n equal records gives n - 1 pairs instead of n²/2.

    Near values meet through the hash of a shared deletion variant, and are then compared. Every
    variant group is bounded by the alphabet and the length of the text, not by the number of records.
    """
    valued = records.select("id", F.col(field).alias("value")).filter(F.col("value").isNotNull())
    blocked = keys.join(valued, "id").select("id", "rule", "block", "value")
    values = blocked.groupBy("rule", "block", "value").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    records_in_blocks = values.select(F.sum("n")).scalar()
    same = (
        lookup_join(blocked, values, ["rule", "block", "value"], "n", records_in_blocks)
        .filter(F.col("id") != F.col("rep"))
        .select(F.col("rep").alias("l"), F.col("id").alias("r"))
        .distinct()
        .withColumn("kind", F.lit("same"))
    )
    variants = values.withColumn("variant", F.explode(_variants(F.col("value"), max_edits)))
    left = variants.select("rule", "block", "variant", F.col("rep").alias("l"), F.col("value").alias("a"))
    right = variants.select("rule", "block", "variant", F.col("rep").alias("r"), F.col("value").alias("b"))
    near = (
        left.join(right, ["rule", "block", "variant"])
        .filter((F.col("l") < F.col("r")) & (F.levenshtein("a", "b", max_edits) >= 0))
        .select("l", "r")
        .distinct()
        .withColumn("kind", F.lit("near"))
    )
    return same.unionByName(near)


def block_sizes(keys: DataFrame, above: int = 0) -> DataFrame:
    """Records per block, only blocks larger than `above`: the report on oversized blocks."""
    return keys.groupBy("rule", "block").agg(F.count("*").alias("records")).filter(F.col("records") > above)


def level(a: Column, b: Column, steps: Sequence[str | tuple[str, int]]) -> Column:
    """Agreement level of two values: the first step that holds, counted down from `len(steps)`.

    Steps are `exact`, `phonetic` or `('edit', n)`. No agreement is 0, a NULL on either side -1.
    """
    out = F.when(a.isNull() | b.isNull(), F.lit(-1))
    for i, step in enumerate(steps):
        if step == "exact":
            holds = a == b
        elif step == "phonetic":
            holds = phonetic(a) == phonetic(b)
        else:
            holds = F.levenshtein(a.cast("string"), b.cast("string"), step[1]) >= 0
        out = out.when(holds, F.lit(len(steps) - i))
    return out.otherwise(F.lit(0))


def compare(pairs: DataFrame, records: DataFrame, fields: Mapping[str, Sequence]) -> DataFrame:
    """Comparison vector per pair: one `<field>_level` column per field; `records` unique by `id`."""
    names = list(fields)
    left = records.select(F.col("id").alias("l"), *[F.col(c).alias(f"_a_{c}") for c in names])
    right = records.select(F.col("id").alias("r"), *[F.col(c).alias(f"_b_{c}") for c in names])
    # a representative is the left end of all its copies; the records are unique, so adaptive
    # execution splits such an end over many tasks, and the pairs are computed only once
    both = pairs.join(left, "l").join(right, "r")
    levels = [level(F.col(f"_a_{c}"), F.col(f"_b_{c}"), steps).alias(f"{c}_level") for c, steps in fields.items()]
    return both.select(*pairs.columns, *levels)


def score(vectors: DataFrame, params: Mapping[str, Mapping[int, tuple[float, float]]]) -> DataFrame:
    """Add `weight`, the sum over fields of log2(m/u); a NULL level adds nothing.

    `params` maps field to level to `(m, u)`. It is as small as the number of levels and becomes a
    literal expression.
    """
    weight = F.lit(0.0)
    for field, levels in params.items():
        part = F.lit(0.0)
        for value, (m, u) in levels.items():
            part = F.when(F.col(f"{field}_level") == value, F.lit(math.log2(m / u))).otherwise(part)
        weight = weight + part
    return vectors.withColumn("weight", weight)


def estimate(
    vectors: DataFrame, fields: Sequence[str], iterations: int = 20, prior: float = 0.1
) -> tuple[dict[str, dict[int, tuple[float, float]]], float]:
    """m, u and the match share by expectation maximisation.

    Spark reduces the pairs to one row per level pattern. There are at most as many patterns as
    the product of the fields' level counts, so only that table reaches the driver.
    """
    columns = [f"{f}_level" for f in fields]
    patterns = [
        (tuple(r[c] for c in columns), r["n"])
        for r in vectors.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns).collect()
    ]
    if not patterns:
        raise ValueError("no pairs")
    total = sum(n for _, n in patterns)
    seen = {f: sorted({p[i] for p, _ in patterns if p[i] >= 0}) for i, f in enumerate(fields)}
    # start: higher levels are likelier among matches
    m = {f: _shares({v: 2.0 ** (v + 1) for v in seen[f]}) for f in fields}
    u = {f: _shares({v: 2.0 ** -(v + 1) for v in seen[f]}) for f in fields}
    share = prior
    for _ in range(iterations):
        gain = {f: {v: 1e-9 for v in seen[f]} for f in fields}
        loss = {f: {v: 1e-9 for v in seen[f]} for f in fields}
        matched = 0.0
        for pattern, n in patterns:
            a, b = share, 1 - share
            for f, v in zip(fields, pattern):
                if v >= 0:
                    a, b = a * m[f][v], b * u[f][v]
            p = a / (a + b) if a + b else 0.0
            matched += n * p
            for f, v in zip(fields, pattern):
                if v >= 0:
                    gain[f][v] += n * p
                    loss[f][v] += n * (1 - p)
        m = {f: _shares(gain[f]) for f in fields}
        u = {f: _shares(loss[f]) for f in fields}
        share = min(max(matched / total, 1e-9), 1 - 1e-9)
    return {f: {v: (m[f][v], u[f][v]) for v in seen[f]} for f in fields}, share


def _shares(weights: dict[int, float]) -> dict[int, float]:
    total = sum(weights.values()) or 1.0
    return {k: w / total for k, w in weights.items()}


def resolve(records: DataFrame, pairs: DataFrame, threshold: float | None = None, path: str | None = None) -> DataFrame:
    """`(id, entity)`: records joined by accepted pairs; entity is the smallest id.

    With a threshold only pairs of at least that `weight` count. A record without pairs is its own
    entity.
    """
    accepted = pairs if threshold is None else pairs.filter(F.col("weight") >= threshold)
    edges = accepted.select(F.col("l").alias("src"), F.col("r").alias("dst"))
    return connected_components(records.select("id"), edges, path).withColumnRenamed("component", "entity")


def resolve_more(entities: DataFrame, records: DataFrame, pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """`(id, entity)` after new records and pairs, from the `entities` known before them; see `merge_components`."""
    accepted = pairs if threshold is None else pairs.filter(F.col("weight") >= threshold)
    edges = accepted.select(F.col("l").alias("src"), F.col("r").alias("dst"))
    return merge_components(entities.withColumnRenamed("entity", "component"), records.select("id"), edges).withColumnRenamed("component", "entity")
