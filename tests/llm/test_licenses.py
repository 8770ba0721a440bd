import math
import random
import re
from collections import Counter

from cases import DOCS, empty_docs, hard_docs

from lakekit.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w = words(text)
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split(" ")
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = sorted(i for i, _ in found)
    labels = ",".join(sorted({x for _, x in found}))
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, labels


def brute_labels(text, threshold=licenses.THRESHOLD):
    """Every run of every template's length, counted."""
    w = words(text)
    out = set()
    for label, template in licenses.TEMPLATES:
        t = words(template)
        n = math.ceil(len(t) * licenses.STRETCH)
        runs = [set(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))]
        if any(100 * len(r & set(t)) >= round(threshold * 100) * len(set(t)) for r in runs):
            out.add(label)
    return out


def brute_blocks(text, threshold=licenses.THRESHOLD):
    """Runs with enough words, each from the first to the last word of the template in it, joined where they overlap."""
    w = words(text)
    out = []
    for k, (label, template) in enumerate(licenses.TEMPLATES):
        t = set(words(template))
        n = math.ceil(len(words(template)) * licenses.STRETCH)
        spans = []
        for end in range(1, len(w) + 1):
            at = [i for i in range(max(end - n, 0), end) if w[i] in t]
            held = len({w[i] for i in at})
            if w[end - 1] in t and 100 * held >= round(threshold * 100) * len(t):
                if spans and at[0] < spans[-1][2]:
                    spans[-1] = max(held / len(t), spans[-1][0]), spans[-1][1], end
                else:
                    spans.append((held / len(t), at[0], end))
        out += [(label, k, *span) for span in spans]
    return out


def noisy(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "license", "under", "version", "mit", "rights", "all"]
    out = []
    for _ in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            t = words(rng.choice(licenses.TEMPLATES)[1])
            t = [x for x in t if rng.random() > rng.choice([0, 0.1, 0.3])]
            at = rng.randint(0, len(w))
            w[at:at] = t
        out.append(rng.choice([" ", "\n", " - "]).join(w).title())
    return out


def test_base_and_labels(spark):
    docs = hard_docs(spark)
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, t, None, None, 0) for i, t in enumerate(noisy(4))], DOCS))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = licenses.scan(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        text = texts[r["doc_id"]]
        base = brute_base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        expected = {x for x in base[4].split(",") if x} | brute_labels(text)
        assert r["labels"] == ",".join(sorted(expected)), text
        assert [tuple(b) for b in r["blocks"]] == brute_blocks(text), text
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(expected)
    assert sum(bool(r["labels"]) for r in out) > 30


def test_planted_lines(spark):
    rows = [
        (1, "Some words.\nThis work is licensed under the GNU General Public License, version 3."),
        (2, "All rights reserved.\nSome words."),
        (3, "Released under the MIT License."),
        (4, "Licensed under the Apache License, Version 2.0."),
        (5, "Licensed under CC BY-NC 4.0."),
        (6, "The rights of all."),
    ]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert out == {1: "gpl-3", 2: "all-rights-reserved", 3: "mit", 4: "apache-2", 5: "cc-by-nc", 6: ""}


def test_empty_and_clashing(spark):
    assert licenses.scan(empty_docs(spark)).count() == 0
    docs = hard_docs(spark).withColumnsRenamed({"lang": "labels", "source": "_text"})
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(docs, "doc_id", "_text").count() == docs.count()


def test_every_block_is_found(spark):
    line = "released under the MIT License"
    text = f"{line}. {'word ' * 30} {line} {'word ' * 9} all rights reserved"
    docs = spark.createDataFrame([(1, text, None, None, 0)], DOCS)
    found = [(b["label"], b["start"], b["end"], b["share"]) for b in licenses.scan(docs).first()["blocks"]]
    assert found == [("mit", 0, 5, 1.0), ("mit", 35, 40, 1.0), ("all-rights-reserved", 49, 52, 1.0)]


def test_positions_prune_before_counting():
    """Words of a template all over a text: places of its rare words are left out before any run is counted."""
    rng = random.Random(9)
    template = licenses.TEMPLATES[2]
    t = words(template[1])
    text = [x for _ in range(4000) for x in (rng.choice(t), *["other"] * rng.randint(0, 9))]
    text[9000:9000] = t
    matcher = licenses.Matcher(licenses.prepared([template], Counter(text), licenses.THRESHOLD), {})
    found = matcher.blocks([w.encode() for w in text])
    assert [b.template for b in found] == [0] and found[0].share == 1
    assert matcher.seen["places"] > 300 and matcher.seen["left"] <= 10
    assert matcher.seen["counted"] <= 4 * len(t)
