"""Quality classifier learned without labels.

Several heuristic labellers look at every document and say good, bad or nothing; they overlap and
err. Expectation-maximisation estimates how often each is right, and how common good documents are,
from the patterns of their votes over all documents. The posterior of a document's pattern is then
the label from which a linear scorer learns, on hashed features: runs of character shapes, which the
labellers do not use, and how words and lines repeat. The scorer judges every document.
Words repeat near by (within blocks of `BLOCK` words) or far apart (runs of `RUN` words that stood in
the text before); both are taken over all words of a text of any length.

There are at most three to the power of the labellers vote patterns, so their counts are small
whatever the data is. The scorer learns from the `SAMPLE` documents with the smallest hashes of id
and text, equal rows once; this bound is a parameter. Documents without a word (null, empty, white
space) are rejected with score 0. Rows are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light, pieces

SAMPLE = 8_000
FEATURES = 1 << 12
BLOCK = 1_500
RUN = 5
THRESHOLD = 0.5
EM_ROUNDS = 200
EPOCHS = 12

BAD, GOOD, SILENT = 0, 1, 2


def near_repeats(words: list) -> float:
    """Mean share of the words that stood before in their block; blocks cover the text, the last one ends with it."""
    size = min(BLOCK, len(words))
    starts = [*range(0, len(words) - size, size), len(words) - size]
    return 1 - sum(len(set(words[i : i + size])) for i in starts) / (size * len(starts))


def far_repeats(words: list) -> float:
    """Share of the runs of `RUN` words that stood before, anywhere in the text."""
    runs = len(words) - RUN + 1
    return 1 - len(set(map(hash, zip(*(words[i:] for i in range(RUN)))))) / runs if runs > 0 else 0.0


# --- labellers ----------------------------------------------------------------------------------

MARKS = b"!?#$%&*<>|^~=_{}\\@+"
PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
ENDS = tuple(c.encode("utf-8") for c in ".!?:;…\"'»”’)]")
CAPITALS = bytes(range(65, 91))
LABELLERS = 8


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else SILENT


def votes(text: str | None) -> tuple[int, ...]:
    """One vote per labeller. Every kind of junk should meet several of them."""
    data = text.encode("utf-8") if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return (BAD,) * LABELLERS
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    marks = len(data) - len(data.translate(None, MARKS))
    capitals = len(data) - len(data.translate(None, CAPITALS)) + data.count(b"\xc3") - sum(data.count(b"\xc3" + bytes([c])) for c in SMALL)
    odd = sum(w[-1] in PUNCTUATION and (len(w) == 1 or w[-2] in PUNCTUATION) for w in words)
    ended = sum(x.endswith(ENDS) and (len(x) < 2 or x[-2] not in PUNCTUATION) for x in lines)
    twice = sum(map(eq, words, words[1:]))
    top = max(Counter(words).values())
    repeated = near_repeats(words)
    return (
        _vote(marks > 0.3 * n, marks < 0.1 * n),
        _vote(odd > 0.25 * n, odd < 0.1 * n),
        _vote(ended < 0.5 * len(lines), ended > 0.8 * len(lines)),
        _vote(n >= 30 and repeated > 0.75, repeated < 0.6),
        _vote(capitals > 0.25 * len(data), capitals < 0.1 * len(data)),
        _vote(n >= 10 and twice > 0.1 * n, twice < 0.02 * n),
        _vote(n >= 10 and top > 0.2 * n, top < 0.12 * n),
        _vote(len(data) > 30 * n, n >= 30 and 3 * n < len(data) < 15 * n),
    )


# second bytes of the small letters of the Latin-1 block
SMALL = range(0x9F, 0xC0)


# --- accuracies of the labellers ----------------------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for every labeller how it votes on bad and on good ones."""

    good: float
    tables: np.ndarray  # labellers x (bad, good) x (bad, good, silent)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.log(np.array([1 - self.good, self.good]))[None, :]
        for j in range(patterns.shape[1]):
            logs = logs + np.log(self.tables[j][:, patterns[:, j]]).T
        top = logs.max(axis=1, keepdims=True)
        odds = np.exp(logs - top)
        return odds[:, 1] / odds.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, from labellers that are mostly right."""
    start = np.array([[0.6, 0.1, 0.3], [0.05, 0.65, 0.3]])
    model = LabelModel(0.8, np.repeat(start[None], patterns.shape[1], axis=0))
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([counts * (1 - good), counts * good])
        tables = np.ones_like(model.tables)
        for j in range(patterns.shape[1]):
            for vote in (BAD, GOOD, SILENT):
                tables[j, :, vote] += weight[:, patterns[:, j] == vote].sum(axis=1)
        tables /= tables.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        settled = abs(share - model.good) < 1e-9 and np.abs(tables - model.tables).max() < 1e-9
        model = LabelModel(float(share), tables)
        if settled:
            break
    return model


def learn_labels(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """The label model of all documents; what comes back is one row per vote pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in pieces(batches, 0):
            seen.update(map(votes, part.column(0).to_pylist()))
        columns = [pa.array([list(p) for p in seen], type=pa.list_(pa.int32())), pa.array(list(seen.values()), type=pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["votes", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.mapInArrow(light(run), "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in found], dtype=np.int64).reshape(-1, LABELLERS)
    return fit_labels(patterns, np.array([r["n"] for r in found], dtype=np.float64))


# --- hashed features ----------------------------------------------------------------------------

_SHAPES: list[np.ndarray] = []


def _shape_table() -> np.ndarray:
    """Class of every code point: small letter, capital, digit, space, line feed, ASCII mark by itself, other."""
    if not _SHAPES:
        table = np.full(0x110000, 6, dtype=np.int64)
        for code in range(0x3000):
            c = chr(code)
            if c.isalpha():
                table[code] = 1 if c.isupper() else 0
            elif c.isdigit():
                table[code] = 2
            elif c == "\n":
                table[code] = 4
            elif c.isspace():
                table[code] = 3
            elif code < 128:
                table[code] = code
        table[0x3000:] = 5
        _SHAPES.append(table)
    return _SHAPES[0]


def _hashed(kind: int, values: np.ndarray) -> np.ndarray:
    h = (values.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(52)).astype(np.int64) % FEATURES


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their values; without a word, none."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
    shapes = _shape_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    # of equal shapes in a row two tell enough
    shapes = np.concatenate(([4], shapes, [4]))
    longer = np.zeros(len(shapes), dtype=bool)
    longer[2:] = (shapes[2:] == shapes[1:-1]) & (shapes[1:-1] == shapes[:-2])
    shapes = shapes[~longer]
    runs = shapes[:-2] << 14 | shapes[1:-1] << 7 | shapes[2:]
    names, counts = np.unique(_hashed(1, runs), return_counts=True)
    # short texts tell little
    values = np.log1p(100.0 * counts / (len(runs) + 40))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (
        sum(a == b for a, b in zip(words, words[1:])) / len(words),
        near_repeats(words),
        1 - len(set(lines)) / len(lines),
        min(len(words) / max(len(lines), 1), 200) / 200,
        far_repeats(words),
    )
    steps = np.array([k << 8 | int(x * 10) for k, x in enumerate(shares)])
    names = np.concatenate((names, _hashed(2, steps), [0]))
    return names, np.concatenate((values, np.ones(len(steps) + 1))).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (names, values) in enumerate(rows):
        np.add.at(out[i], names, values)
    return out


# --- scorer -------------------------------------------------------------------------------------


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, by AdaGrad over small batches in a fixed order."""
    weights, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), 128):
            batch = order[begin : begin + 128]
            x = _dense([rows[i] for i in batch]).astype(np.float64)
            error = 1 / (1 + np.exp(-(x @ weights))) - good[batch]
            slope = x.T @ error / len(batch) + 1e-5 * weights
            seen += slope * slope
            weights -= 0.2 * slope / np.sqrt(seen)
    return weights


def learning_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """`(place, names, values, votes)` of the `sample` documents with the smallest hashes of id and text.

    Equal rows are one document. Features are made where the texts are, once per task and document.
    """
    text = F.col(f"`{text_col}`").cast("string")
    placed = docs.select(text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(3)).alias("place"))
    smallest = placed.select("place").distinct().orderBy("place").limit(sample)
    last = smallest.agg(F.max("place").alias("place")).first()["place"]
    chosen = placed.filter(F.col("place") <= F.lit(last).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in pieces(batches, 0):
            fresh = {}
            for at, place in enumerate(part.column(1).to_pylist()):
                if place not in seen:
                    seen.add(place)
                    fresh[place] = at
            texts = part.column(0).take(pa.array(list(fresh.values()), type=pa.int64())).to_pylist()
            found = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(fresh), type=pa.int64()),
                    pa.array([n.tolist() for n, _ in found], type=pa.list_(pa.int64())),
                    pa.array([v.tolist() for _, v in found], type=pa.list_(pa.float32())),
                    pa.array([list(votes(t)) for t in texts], type=pa.list_(pa.int32())),
                ],
                names=["place", "names", "values", "votes"],
            )

    coded = chosen.mapInArrow(light(run), "place bigint, names array<bigint>, values array<float>, votes array<int>")
    return coded.dropDuplicates(["place"])


def learn_scorer(docs: DataFrame, model: LabelModel, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights, learned from the posteriors of `sample` documents at most."""
    got = [r for r in learning_rows(docs, id_col, text_col, sample).collect() if r["names"]]
    if not got:
        return np.zeros(FEATURES)
    got.sort(key=lambda r: r["place"])
    rows = [(np.array(r["names"]), np.array(r["values"], dtype=np.float32)) for r in got]
    return fit_scorer(rows, model.posterior(np.array([r["votes"] for r in got], dtype=np.int64)))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """Adds the scorer's probability that a document is good; 0 for one without a word."""
    if score_col == text_col:
        raise ValueError("the score needs a column of its own")
    kept = [c for c in docs.columns if c != score_col]
    held = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            out = []
            for text in part.column(at).to_pylist():
                names, values = features(text)
                out.append(float(1 / (1 + np.exp(-np.clip(weights[names] @ values, -500, 500)))) if len(names) else 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, type=pa.float64())], names=[*kept, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(light(run), f"{fields}, `{score_col}` double")


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality_score", sample: int = SAMPLE
) -> DataFrame:
    """Adds `score_col`, learned from these documents themselves; below `THRESHOLD` a document is rejected."""
    weights = learn_scorer(docs, learn_labels(docs, text_col), id_col, text_col, sample)
    return score(docs, weights, text_col, score_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected; columns as they were."""
    name = next(n for n in ("_quality", "_quality_", "_quality__") if n not in docs.columns)
    judged = classify(docs, id_col, text_col, name)
    return judged.filter(F.col(name) >= threshold).drop(name)
