import numpy as np
from cases import DOCS, empty_docs, hard_docs
from pyspark.sql import functions as F

from lakekit.llm import quality_model as q


def test_em_finds_the_accuracies():
    """Votes drawn from known tables: the model comes back to them without a label."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.85, 0.7]
    columns = []
    for p in right:
        vote = np.where(rng.random(len(truth)) < p, truth, ~truth).astype(int)
        columns.append(np.where(rng.random(len(truth)) < 0.2, q.SILENT, vote))
    patterns, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    model = q.fit_labels(patterns, counts.astype(float))
    assert abs(model.good - 0.8) < 0.02
    for j, p in enumerate(right):
        assert abs(model.tables[j, 1, q.GOOD] / (1 - model.tables[j, 1, q.SILENT]) - p) < 0.03
    good = model.posterior(np.stack(columns, axis=1)) > 0.5
    majority = (np.stack(columns, axis=1) == q.GOOD).sum(axis=1) > (np.stack(columns, axis=1) == q.BAD).sum(axis=1)
    assert (good == truth).mean() > 0.93 and (good == truth).mean() >= (majority == truth).mean()


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(5)
    votes = rng.integers(0, 3, (300, 3))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    one, two = q.fit_labels(patterns, counts.astype(float), 7), q.fit_labels(votes, np.ones(300), 7)
    assert abs(one.good - two.good) < 1e-9 and np.abs(one.tables - two.tables).max() < 1e-9


def test_junk_is_rejected_and_prose_is_kept(spark):
    """Agreement with the given labels, which the model never sees."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = q.classify(docs.select("doc_id", "text")).join(labels, "doc_id").select("quality", "quality_score").collect()
    good = [r["quality_score"] >= q.THRESHOLD for r in out if r["quality"] == 1]
    junk = [r["quality_score"] >= q.THRESHOLD for r in out if r["quality"] == 0]
    assert len(junk) > 300 and sum(junk) <= 0.05 * len(junk)
    assert sum(good) >= 0.99 * len(good)


def test_hard_rows(spark):
    docs = hard_docs(spark).withColumnRenamed("lang", "quality_score")
    out = q.classify(docs).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["quality_score"] <= 1 for r in out)
    assert all(r["quality_score"] == 0 for r in out if not (r["text"] or "").split())
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() <= docs.count()


def test_empty_table_and_rerun(spark):
    assert q.classify(empty_docs(spark)).count() == 0
    docs = hard_docs(spark)
    a = {(r["doc_id"], r["quality_score"]) for r in q.classify(docs).collect()}
    assert a == {(r["doc_id"], r["quality_score"]) for r in q.classify(docs.repartition(5)).collect()}


def test_no_word_at_all(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, None, 0)], DOCS)
    assert [r["quality_score"] for r in q.classify(docs).collect()] == [0.0, 0.0]


def random_words(n, seed=7, vocabulary=3_400):
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, n)]


def differing(a, b):
    return set(q.features(" ".join(a))[0].tolist()) ^ set(q.features(" ".join(b))[0].tolist())


def test_repeats_are_seen_in_the_middle_of_long_texts():
    """Same ends, same character shapes, same lengths; only the words between repeat."""
    plain = random_words(9_000)
    three = plain[:1_500] + plain[1_500:1_503] * 2_000 + plain[-1_500:]
    assert q.near_repeats(three) > q.near_repeats(plain) + 0.3
    assert q.far_repeats(three) > 0.6 and q.far_repeats(plain) < 0.01
    steps = {int(q._hashed(2, np.array([k << 8 | int(f(three) * 10)]))[0]) for k, f in ((1, q.near_repeats), (4, q.far_repeats))}
    assert steps <= differing(plain, three)


def test_a_passage_longer_than_a_block_is_seen_again():
    passage = [f"w{i}" for i in range(2 * q.BLOCK)]
    assert q.near_repeats(passage * 4) == 0 and q.far_repeats(passage * 4) > 0.7


def test_repeats_do_not_grow_with_length():
    shares = [q.near_repeats(random_words(n)) for n in (q.BLOCK, q.BLOCK + 9, 2 * q.BLOCK, 6 * q.BLOCK, 60 * q.BLOCK)]
    assert max(shares) - min(shares) < 0.03
    assert q.near_repeats(["a", "b", "a"]) == 1 - 2 / 3 and q.far_repeats(["a", "b", "a"]) == 0


def test_the_vocabulary_vote_is_the_same_at_every_length():
    few, many = random_words(100_000, vocabulary=300), random_words(100_000)
    for n in (2_000, 20_000, 100_000):
        assert q.votes(" ".join(few[:n]))[3] == q.BAD
        assert q.votes(" ".join(many[:n]))[3] == q.GOOD
    assert q.votes("a b c d e " * 6)[3] == q.BAD and q.votes("a b c d e " * 5)[3] == q.SILENT


def test_equal_rows_do_not_fill_the_sample(spark):
    """One row that is there 3,000 times: the sample and the weights are those without its copies, on every run."""
    texts = [" ".join(random_words(40, seed)) + "." * (seed % 3) for seed in range(300)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    copies = spark.range(3_000).selectExpr("cast(null as bigint) doc_id", "'the same text' text", "null lang", "null source", "0L n_chars")
    model = q.learn_labels(docs)
    plain = q.learn_scorer(docs.union(copies.limit(1)), model, sample=50)
    for many in (docs.union(copies), copies.union(docs).repartition(7)):
        places = [r["place"] for r in q.learning_rows(many, sample=50).collect()]
        assert len(places) == len(set(places)) == 50
        assert np.array_equal(q.learn_scorer(many, model, sample=50), plain)


def plain_labels(voted):
    """Expectation-maximisation document by document: share of good ones, tables, and every document's posterior."""
    share = 0.8
    tables = [[[0.6, 0.1, 0.3], [0.05, 0.65, 0.3]] for _ in range(q.LABELLERS)]

    def posterior(v):
        odds = [1 - share, share]
        for j, x in enumerate(v):
            odds = [odds[k] * tables[j][k][x] for k in (0, 1)]
        return odds[1] / sum(odds)

    for _ in range(q.EM_ROUNDS):
        good = [posterior(v) for v in voted]
        new = [[[1.0] * 3 for _ in range(2)] for _ in range(q.LABELLERS)]
        for v, p in zip(voted, good):
            for j, x in enumerate(v):
                new[j][0][x] += 1 - p
                new[j][1][x] += p
        new = [[[x / sum(row) for x in row] for row in table] for table in new]
        moved = max(abs(a - b) for t, o in zip(new, tables) for r, s in zip(t, o) for a, b in zip(r, s))
        before, share, tables = share, (sum(good) + 1) / (len(voted) + 2), new
        if abs(share - before) < 1e-9 and moved < 1e-9:
            break
    return [posterior(v) for v in voted]


def plain_scores(rows, sample):
    """The whole query without Spark: posteriors of all rows, a scorer on the smallest places, a score per text."""
    good = plain_labels([q.votes(text) for _, text in rows])
    by_place = {place: (text, p) for (place, text), p in zip(rows, good)}
    chosen = [by_place[k] for k in sorted(by_place)[:sample]]
    learned = [(q.features(text), p) for text, p in chosen if len(q.features(text)[0])]
    weights, seen, rng = np.zeros(q.FEATURES), np.full(q.FEATURES, 1e-6), np.random.default_rng(11)
    for _ in range(q.EPOCHS):
        order = rng.permutation(len(learned))
        for begin in range(0, len(learned), 128):
            batch = [learned[i] for i in order[begin : begin + 128]]
            slope = np.zeros(q.FEATURES)
            for (names, values), p in batch:
                error = 1 / (1 + np.exp(-sum(weights[n] * float(v) for n, v in zip(names, values)))) - p
                for n, v in zip(names, values):
                    slope[n] += error * float(v)
            slope = slope / len(batch) + 1e-5 * weights
            seen += slope**2
            weights -= 0.2 * slope / np.sqrt(seen)
    out = {}
    for place, text in rows:
        names, values = q.features(text)
        out[place] = 1 / (1 + np.exp(-sum(weights[n] * float(v) for n, v in zip(names, values)))) if len(names) else 0.0
    return out


def test_whole_query_against_plain_loops(spark):
    place = F.xxhash64("doc_id", "text", F.lit(3)).alias("place")
    docs = hard_docs(spark)
    rows = [(r["place"], r["text"]) for r in docs.select(place, "text").collect()]
    for sample in (q.SAMPLE, 25):
        expected = plain_scores(rows, sample)
        got = q.classify(docs, sample=sample).select(place, "quality_score").collect()
        assert len(got) == len(rows)
        assert max(abs(r["quality_score"] - expected[r["place"]]) for r in got) < 1e-5
