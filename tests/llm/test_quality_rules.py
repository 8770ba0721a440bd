import random
from collections import Counter

import pytest
from cases import empty_docs, hard_docs, words
from pyspark.sql import functions as F

from lakekit.llm import quality_rules


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w),
    }


def test_measures(spark):
    docs = hard_docs(spark)
    out = quality_rules.clean(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        expected = brute(r["text"])
        assert {k: r[k] for k in expected} == expected, r["text"]
        assert not (r["kept"] and r["base_failed"])


def test_empty_and_clashing(spark):
    assert quality_rules.clean(empty_docs(spark)).count() == 0
    docs = hard_docs(spark).withColumnsRenamed({"lang": "kept", "source": "n_words"})
    assert quality_rules.clean(docs).count() == docs.count()
    inner = hard_docs(spark).withColumnsRenamed({"lang": "_own0", "source": "_words"})
    kept = quality_rules.clean(inner).select(*inner.columns)
    assert kept.exceptAll(inner).count() == 0 and inner.exceptAll(kept).count() == 0


@pytest.mark.parametrize(
    "line, fails",
    [
        ("This is a plain sentence with words.", False),
        ("He said so, and she agreed; it was fine!", False),
        ("One sentence ends here. Another goes on", False),
        ("Home | About | Contact | Login", True),
        ("All rights reserved.", True),
        ("This line just stops without any mark", True),
        ("Alle Rechte vorbehalten.", True),
        ("\tHome and away | we go together.", False),
        ("\t \tHome | we all go.", True),
        (" \x0bone two three four five six seven | eight.\x0c", False),
        ("WHAT!! IS!! THIS!! KIND!! OF!! LINE!! SUPPOSED!! TO!! BE!! HERE!!", True),
    ],
)
def test_lines(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality_rules.line_fails(F.col("x"))).first()[0] is fails


def brute_line(line, boilerplate=quality_rules.BOILERPLATE):
    n = len(words(line))
    bars = sum(c in "|•»›" for c in line)
    marks = sum(c in "!?.,;:|#$%&*<>@~^=+_/\\\"()[]{}" for c in line)
    end = line.rstrip(" \t\n\x0b\x0c\r")
    stops = end != "" and end[-1] in ".!?:;…\"'»”’)]"
    inner = any(a.isalpha() and b in ".!?…" and c == " " for a, b, c in zip(line, line[1:], line[2:]))
    navigation = bars * 4 >= n and bars >= 2 or bars >= 1 and n <= 6
    phrase = n <= 40 and any(p in line.lower() for p in boilerplate)
    return navigation or phrase or not (stops or inner) or marks > n * 0.6 + 3


def test_lines_against_plain_rules(spark):
    """Random lines with tabs and other white space in front, inside and behind."""
    rng = random.Random(3)
    parts = ["word", "Über", "|", "»", "end.", "so!", "(a)", "x;", "[b]", "\\", "click here", "Cliquez ici", "politique de confidentialité"]
    gaps = [" ", " ", " ", "\t", "  ", "\x0b", "\r", "\x0c "]
    lines = [
        rng.choice(["", *gaps]) + "".join(rng.choice(parts[: rng.choice([2, 6, 13])]) + rng.choice(gaps) for _ in range(rng.randint(1, 60)))
        for _ in range(600)
    ]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", quality_rules.line_fails(F.col("x")).alias("fails")).collect()
    assert [(r.x, r.fails) for r in got] == [(x, brute_line(x)) for x in lines]
    assert 100 < sum(r.fails for r in got) < 580


def test_own_boilerplate(spark):
    docs = spark.createDataFrame([(1, "Buy our (new) books.\nAll rights reserved.")], "doc_id bigint, text string")
    assert quality_rules.clean(docs, boilerplate=["(new) books"]).first()["clean_text"] == "All rights reserved."
    assert quality_rules.clean(docs, boilerplate=[]).first()["lost"] == 0


def test_prose_is_kept_and_junk_is_not(spark):
    good = "\n".join(" ".join(f"w{i * j}x{i}y{j}" for j in range(9)) + "." for i in range(20))
    junk = "\n".join(f"item{i} | thing{i} | other{i} | more{i} | last{i}" for i in range(20))
    out = quality_rules.clean(spark.createDataFrame([(1, good), (2, junk)], "doc_id bigint, text string"))
    assert {r["doc_id"]: r["kept"] for r in out.collect()} == {1: True, 2: False}
