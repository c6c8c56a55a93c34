import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hudlake.llm import queries, shared, toxicity
from pyspark.sql import functions as F


SF = "/root/testdata/sf0.1"


def brute(text):
    """(n-gram, level) for each level that the n-gram's occurrences reach."""
    raw = (" " + (text or "") + " ").translate({c: 32 for c in range(9, 14)}).encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    times = Counter((n, low[i : i + n]) for n in toxicity.GRAMS for i in range(len(low) - n + 1))
    return {(g, level) for g, c in times.items() for level in toxicity.LEVELS if c >= level}


def test_features_are_the_texts_ngrams():
    texts = [None, "", "a", "Hello hello", "Ünï\tcödé", "x" * 50, "go on go on go on go on"]
    sets = toxicity.feature_sets(texts)
    assert [len(s) for s in sets] == [len(brute(t)) for t in texts]  # no two of these share a bucket
    assert (sets[2] == toxicity.feature_sets(["a"])[0]).all()
    assert [s.tolist() for s in toxicity.feature_sets(texts)] == [s.tolist() for t in texts for s in toxicity.feature_sets([t])]


def test_scores_do_not_depend_on_slices():
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=toxicity.FEATURES).astype("f4") * (rng.random(toxicity.FEATURES) < 0.1), -1.0)
    texts = ["some words here", None, "others " * 50, "", "more"]
    alone = np.concatenate([m.score([t]) for t in texts])
    assert np.allclose(m.score(texts), alone, atol=1e-12)
    for t, s in zip(texts, alone):
        z = m.weights[toxicity.feature_sets([t])[0]].astype("f8").sum() - 1
        assert np.isclose(s, 1 / (1 + np.exp(-z)))


def test_fit_against_a_plain_version():
    """Ratios from sets of n-grams, and a regression by many plain gradient steps, give the same scores."""
    rows = corpus(120)
    sets, y = toxicity.feature_sets([t for _, t, _ in rows]), np.array([v for _, _, v in rows])
    p, q = (np.bincount(np.concatenate([s for s, v in zip(sets, y) if v == c]), minlength=toxicity.FEATURES) for c in (1, 0))
    ratio = toxicity.ratios(p, q, int(y.sum()), int((1 - y).sum()))
    for k in np.flatnonzero(p + q)[::997].tolist():
        a, b = (sum(k in s for s, v in zip(sets, y) if v == c) for c in (1, 0))
        want = np.log((a + 0.5) / (y.sum() + 1)) - np.log((b + 0.5) / ((1 - y).sum() + 1))
        assert np.isclose(ratio[k], want if a + b >= toxicity.LEAST_TEXTS and abs(want) >= toxicity.LEAST_RATIO else 0)
    kept = [s[ratio[s] != 0] for s in sets]
    model = toxicity.fit(np.concatenate(kept), np.array(list(map(len, kept))), y, ratio)
    x = np.zeros((len(rows), len(ratio)), "f4")
    for i, s in enumerate(kept):
        x[i, s] = ratio[s]
    x = x[:, ratio != 0].astype("f8")
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4000):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.02 * (x.T @ off + toxicity.PENALTY / 50 * w) / len(y), b - 0.02 * off.mean()
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    got = model.score([t for _, t, _ in rows])
    assert ((plain >= 0.5) == y).all() and ((got >= 0.5) == y).all() and np.corrcoef(plain, got)[0, 1] > 0.98


def test_samples_hold_repeated_ids(spark):
    """The rows of the smallest hashes, whatever the number of rows of an id."""
    rows = [(i, k) for i in range(6) for k in range(900)] + [(i, 0) for i in range(6, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, k long")
    order = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).distinct().collect()}
    want = sorted(rows, key=lambda r: (order[r[0]], *r))
    for n in (1, 40, 1500, 20000):
        assert sorted(map(tuple, shared.hash_sample(df, n, ["doc_id", "k"]).collect())) == sorted(want[:n])


def test_a_repeated_label_is_one_example(spark):
    """5,000 rows that repeat one label leave the sample to the others."""
    for one in (1, 7, 9, 12, 20):
        df = spark.createDataFrame([(one, 1)] * 5000 + [(100 + i, 1) for i in range(900)], "doc_id long, toxic int")
        assert shared.hash_sample(df, 1500, ["doc_id"]).count() == 901


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_held_out_rows_of_the_test_tables(spark):
    """Recall and false positives on the labelled rows that are never learned from."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").distinct()
    rows = queries.QUERIES["op4_toxicity"](spark, SF).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 100 and sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 5


def test_repeated_rows_and_clashing_columns(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t, 0.25) for i, t, _ in rows] + [(0, rows[0][1], 0.25)] * 40 + [(7000, "word " * 200_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    plain = toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), labels)
    assert np.array_equal(model.weights, plain.weights) and model.intercept == plain.intercept
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 241
    assert toxicity.score(docs, model, "score_").where("score_ >= 0 AND score IN (0.25, 1.0)").count() == 241


def corpus(n=600):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["an", "the", "re", "on", "st", "ing", "ou"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Vilest", "zorgful", "mukking"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, "x", 0.0), (1000, None, 0.0), (1001, "", 0.0)], "doc_id long, text string, predicted double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.h and r.doc_id in truth]
    assert 150 < len(held) < 250
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.score < 0.7 for r in got if r.doc_id in (1000, 1001))


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.score < 1e-9 for r in toxicity.score(docs, model).collect()] == [True]
    assert toxicity.score(docs.limit(0), model).collect() == []
