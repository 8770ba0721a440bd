"""License scan: phrases, and text blocks that contain a license template almost whole.

The template step is an exact set-similarity join of templates with blocks. For a template of n words
a block is every run of `STRETCH * n` consecutive words of a text; it meets the template when it holds
a share `threshold` of its distinct words or more. The frequencies of the templates' words are counted
over all documents and put every template's words in one order, rare ones first. A block that holds
enough words holds one of the first ones, so blocks are looked for only around places of these (prefix
filter), and only in texts with enough of the template's distinct words (length filter). Such a place
stands for the blocks in which its word is the first in the order: all words before it are missing
there, and the words behind it are looked up in order within reach of the place until too many are
missing (positional filter). What is left is counted exactly.

Templates are a list given as a parameter, so their words and frequencies are of bounded size. Null
texts are empty: no words, no labels, score 0. Rows are kept as they are. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that authors put above or below a text; the label is the license named there.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License see LICENSE in the project root for license information"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "this work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.9
STRETCH = 1.25

# Words are runs of ASCII letters and digits and of anything beyond ASCII; in UTF-8 that is a byte class.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
TO_SPACE = bytes.maketrans(NO_WORD, b" " * len(NO_WORD))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().translate(TO_SPACE).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rare ones first
    least: int  # words that must be there
    prefix: int  # one of so many first words is there then
    run: int  # words of a block


def frequencies(docs: DataFrame, text_col: str, words: set[bytes]) -> dict[bytes, int]:
    """How often each of `words` occurs in all texts: one row per word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in pieces(batches, 0):
            for text in part.column(0).to_pylist():
                found = words_of(text)
                total.update({w: n for w, n in Counter(found).items() if w in words})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), type=pa.binary()), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"]
        )

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    summed = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in summed.collect()}


def prepared(templates: Sequence[tuple[str, str]], often: Mapping[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        every = words_of(text)
        words = sorted(set(every), key=lambda w: (often.get(w, 0), w))
        least = max(-(-len(words) * round(threshold * 100) // 100), 1)
        out.append(Template(label, tuple(words), least, len(words) - least + 1, math.ceil(len(every) * STRETCH)))
    return out


class Block(NamedTuple):
    template: int
    share: float  # of the template's distinct words, in its best run
    start: int
    end: int  # exclusive, in words


class Matcher:
    """Templates by the words of their prefixes; counts what its filters leave."""

    def __init__(self, templates: Sequence[Template], phrases: Mapping[str, str]):
        self.templates = templates
        self.index: dict[bytes, list[int]] = defaultdict(list)
        for k, t in enumerate(templates):
            for word in t.words[: t.prefix]:
                self.index[word].append(k)
        self.marks = frozenset(self.index)
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.seen = Counter()  # places of prefix words, those left by position, words counted

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Word places where a phrase stands, and its label."""
        line = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.phrases:
            at, begin, count = line.find(phrase), 0, 0
            while at >= 0:
                count += line.count(b" ", begin, at)
                out.append((count, label))
                begin = at
                at = line.find(phrase, at + 1)
        return sorted(out)

    def blocks(self, words: list[bytes]) -> list[Block]:
        """All blocks of `words`; runs that overlap are one block."""
        there = self.vocabulary.intersection(words)
        near = {k for w in there & self.marks for k in self.index[w]}
        near = [k for k in sorted(near) if len(there.intersection(self.templates[k].words)) >= self.templates[k].least]
        if not near:
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        wanted = {w for k in near for w in self.templates[k].words}
        for i, word in enumerate(words):
            if word in wanted:
                places[word].append(i)
        out = []
        for k in near:
            found = [places.get(w, ()) for w in self.templates[k].words]
            for begin, end in self._regions(found, self.templates[k]):
                out += [Block(k, *b) for b in self._runs(found, self.templates[k], begin, end)]
        return out

    def _regions(self, found: Sequence[Sequence[int]], t: Template) -> list[tuple[int, int]]:
        """Stretches of words within reach of a prefix word that the positional filter leaves, joined if they meet."""
        left = []
        for first in range(t.prefix):
            for at in found[first]:
                self.seen["places"] += 1
                if self._may_hold(found, t, first, at):
                    left.append(at)
        self.seen["left"] += len(left)
        regions: list[tuple[int, int]] = []
        for at in sorted(left):
            begin, end = at - t.run + 1, at + t.run
            if regions and begin <= regions[-1][1]:
                regions[-1] = regions[-1][0], end
            else:
                regions.append((begin, end))
        return regions

    @staticmethod
    def _may_hold(found: Sequence[Sequence[int]], t: Template, first: int, at: int) -> bool:
        """Whether a run with place `at`, in which word `first` is the first in the order, may hold enough."""
        matched = 1
        for word in range(first + 1, len(t.words)):
            if matched + len(t.words) - word < t.least:
                return False
            near = bisect_left(found[word], at - t.run + 1)
            matched += near < len(found[word]) and found[word][near] < at + t.run
        return matched >= t.least

    def _runs(self, found: Sequence[Sequence[int]], t: Template, begin: int, end: int) -> list[tuple[float, int, int]]:
        """Slides over the template's words in a stretch, with a count of each in the run."""
        hits = sorted((i, w) for w, p in enumerate(found) for i in p[bisect_left(p, begin) : bisect_left(p, end)])
        self.seen["counted"] += len(hits)
        inside = [0] * len(t.words)
        distinct, first = 0, 0
        out: list[tuple[float, int, int]] = []
        for at, word in hits:
            inside[word] += 1
            distinct += inside[word] == 1
            while hits[first][0] <= at - t.run:
                gone = hits[first][1]
                inside[gone] -= 1
                distinct -= inside[gone] == 0
                first += 1
            if distinct >= t.least:
                share, start = distinct / len(t.words), hits[first][0]
                if out and start < out[-1][2]:
                    out[-1] = max(share, out[-1][0]), out[-1][1], at + 1
                else:
                    out.append((share, start, at + 1))
        return out


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks)`.

    `blocks` holds every block that meets a template, by template and place: label, number of the template,
    share, first word and the word behind the last. Runs that overlap are one block. `score` is the largest share of a template found in a block, 1 where a phrase stands, and 0
    without any label.
    """
    vocabulary = {w for _, text in templates for w in words_of(text)}
    matcher = Matcher(prepared(templates, frequencies(docs, text_col, vocabulary), threshold), phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            rows = []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                base = matcher.base(words)
                near = matcher.blocks(words)
                labels = {label for _, label in base}
                named = [{"label": matcher.templates[b.template].label, **b._asdict()} for b in near]
                more = labels | {b["label"] for b in named}
                score = 1.0 if base else max((b.share for b in near), default=0.0)
                places = [p for p, _ in base]
                first, last = (places[0], places[-1]) if places else (None, None)
                rows.append((len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(more)), score, named))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), BLOCKS]
            arrays = [pa.array(list(c), type=k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_col, *NAMES])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, "
        "blocks array<struct<label:string,template:int,share:double,start:bigint,end:bigint>>",
    )


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
BLOCKS = pa.list_(
    pa.struct([("label", pa.string()), ("template", pa.int32()), ("share", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
)
