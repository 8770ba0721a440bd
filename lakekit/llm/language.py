"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, made from its code point alone. The vector
of an n-gram binds its letters: their vectors, rotated by their place, are multiplied element by
element. A text's vector bundles, that is adds, the vectors of its n-grams, a language's prototype
those of the texts of that language, each text with the same total weight. A text gets the language
whose prototype has the largest cosine with it.

Texts are lower-cased; whatever is not a letter counts as one gap. Null texts and texts without a
letter get `und` and score 0, as all texts do when there is nothing to learn from. Ties go to the
smaller label. Rows are kept as they are; an empty table gives an empty result. Weights are added up
as integers, so the order of rows and tasks does not change a prototype.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

DIMENSIONS = 1024
ORDER = 3
SCALE = 1 << 24
# Labels come to the driver with one vector each.
MOST_LABELS = 10_000
UNKNOWN = "und"

# Distinct n-grams of a slice whose vectors are held together; beyond, every text makes its own in blocks.
MOST_GRAMS = 1 << 15
_LETTERS: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000))
    return _LETTERS[0]


def letter_vector(code: int) -> np.ndarray:
    found = _VECTORS.get(code)
    if found is None:
        bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
        found = _VECTORS[code] = 2 * bits - 1
    return found


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row of plus and minus ones per packed n-gram."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for place in range(ORDER):
        codes = grams >> np.int64(21 * place) & np.int64((1 << 21) - 1)
        letters, where = np.unique(codes, return_inverse=True)
        table = np.array([np.roll(letter_vector(int(c)), place) for c in letters], dtype=np.int8).reshape(-1, DIMENSIONS)
        out *= table[where]
    return out


def grams_of(text: str | None) -> np.ndarray:
    """The n-grams of a text, three code points packed into one number; a gap is code point 0."""
    if not text:
        return np.empty(0, dtype=np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


@dataclass(frozen=True)
class Profiles:
    """Labels and their prototypes, one row of length 1 each."""

    labels: list[str]
    vectors: np.ndarray


def _counted(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, text in enumerate(texts):
        grams = grams_of(text)
        if len(grams):
            yield i, *np.unique(grams, return_counts=True)


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Profiles:
    """Prototypes from all rows with a label; every task sends one vector per label it has seen."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in pieces(batches, 0):
            labels = part.column(1).to_pylist()
            weights: dict[str, list] = {}
            for i, grams, counts in _counted(part.column(0).to_pylist()):
                weights.setdefault(labels[i], []).append((grams, np.round(counts * (SCALE / counts.sum())).astype(np.int64)))
            for label, found in weights.items():
                grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                weight = np.zeros(len(grams), dtype=np.int64)
                np.add.at(weight, where, np.concatenate([w for _, w in found]))
                vector = np.zeros(DIMENSIONS, dtype=np.int64)
                for begin in range(0, len(grams), 4096):
                    # whole numbers far below 2^53, so that the product in doubles is exact
                    block = gram_vectors(grams[begin : begin + 4096]).astype(np.float64)
                    vector += (weight[begin : begin + 4096].astype(np.float64) @ block).astype(np.int64)
                total[label] = total.get(label, 0) + vector
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], type=pa.string()), pa.array([v.tolist() for _, v in rows], type=pa.list_(pa.int64()))],
            names=["label", "vector"],
        )

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    partial = rows.filter("label is not null").mapInArrow(bundle, "label string, vector array<bigint>")
    # in doubles: many tasks' whole numbers may pass 2^63 together, and their sum need not be exact to a unit
    summed = partial.select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x")
    )
    found = summed.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    got = sorted((r["label"], r["v"]) for r in found.limit(MOST_LABELS + 1).collect())
    if len(got) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    vectors = np.array([v for _, v in got], dtype=np.float64).reshape(-1, DIMENSIONS)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([k for k, _ in got], vectors / np.where(size > 0, size, 1))


def _bundled(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted sum of n-gram vectors, made some thousand n-grams at a time."""
    out = np.zeros(DIMENSIONS, dtype=np.float64)
    for begin in range(0, len(grams), 4096):
        out += counts[begin : begin + 4096].astype(np.float32) @ gram_vectors(grams[begin : begin + 4096]).astype(np.float32)
    return out


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the label of the nearest prototype and the cosine with it, 0 at least."""
    if text_col in (label_col, score_col):
        raise ValueError("the results need columns of their own")
    kept = [c for c in docs.columns if c not in (label_col, score_col)]
    held = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    prototypes = profiles.vectors.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at, 1 << 20):
            labels, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
            found = list(_counted(part.column(at).to_pylist())) if len(prototypes) else []
            if found:
                grams, where = np.unique(np.concatenate([g for _, g, _ in found]), return_inverse=True)
                shared = gram_vectors(grams).astype(np.float32) if len(grams) <= MOST_GRAMS else None
                begin = 0
                for i, mine, counts in found:
                    if shared is None:
                        bundled = _bundled(mine, counts)
                    else:
                        bundled = counts.astype(np.float32) @ shared[where[begin : begin + len(mine)]]
                    begin += len(mine)
                    size = float(np.linalg.norm(bundled))
                    if size > 0:
                        cosines = prototypes @ (bundled / size)
                        best = int(np.argmax(cosines))
                        labels[i], scores[i] = profiles.labels[best], float(min(max(cosines[best], 0.0), 1.0))
            new = [pa.array(labels, type=pa.string()), pa.array(scores, type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*kept, label_col, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(run, f"{fields}, `{label_col}` string, `{score_col}` double")


def remainder(id_col: Column, parts: int = 3) -> Column:
    """The part of a document by its id's text; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts
