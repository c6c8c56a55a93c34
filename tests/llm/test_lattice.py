import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hudlake.llm import lattice, pieces, scoring
from hypothesis import given, settings
from hypothesis import strategies as st

V = lattice.Vocabulary()


def segmentations(text):
    """All ways to write a text in pieces, with log probabilities, by recursion over the whole text."""
    out = []

    def go(i, ids, lp):
        if i == len(text):
            out.append((tuple(ids), lp))
            return
        if text[i] not in V.pieces:
            b = text[i].encode()
            go(i + 1, ids + [V.byte_ids[x] for x in b], lp + len(b) * V.byte_log)
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in V.pieces:
                p, w = V.pieces[text[i:j]]
                go(j, ids + [p], lp + w)

    go(0, [], 0.0)
    return out


def test_weights_are_probabilities():
    total = sum(math.exp(w) for p, (_, w) in V.pieces.items()) + 256 * math.exp(V.byte_log) + math.exp(V.end_log)
    assert abs(total - 1) < 1e-9
    assert V.pieces[" the"][1] > V.pieces[" though"][1] > V.byte_log - 1e-9


@pytest.mark.parametrize("text", ["a", "the cat", "  two", "é▁ b", "x\ny", "日本 ok", " "])
def test_marginal_is_the_sum_over_all_segmentations(text):
    want = math.log10(sum(math.exp(lp) for _, lp in segmentations(" " + text)))
    assert abs(lattice.Marginals(V).text(text) - want - V.end_log / math.log(10)) < 1e-9


def test_probabilities_of_all_texts_sum_to_one_at_most():
    """Of all texts of up to three of these letters: their sequences of pieces, counted one by one, have the same mass."""
    letters = "aeinst \n"
    texts = ["", *(a for a in letters), *(a + b for a in letters for b in letters), *(a + b + c for a in letters for b in letters for c in letters)]
    mass = sum(10**x for x in lattice.Marginals(V).texts(texts))
    ways = sum(math.exp(lp + V.end_log) for t in texts if t for _, lp in segmentations(" " + t)) + math.exp(V.end_log)
    assert abs(mass - ways) < 1e-12 and math.exp(V.end_log) < mass < 1


def test_samples_follow_the_segmentations():
    text = "in the"
    all_ways = segmentations(" " + text)
    total = sum(math.exp(lp) for _, lp in all_ways)
    n = 40000
    drawn = Counter(lattice.Sampler(V).sample([text] * n, np.random.default_rng(0).integers(0, 1 << 62, n)))
    for ids, lp in all_ways:
        p = math.exp(lp) / total
        got = drawn[np.array(ids, "<u4").tobytes()] / n
        assert abs(got - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert sum(drawn.values()) == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["", " ", "▁▁", "a  b\n\nc", "\x00", "  lead", "trail  "]), min_size=1, max_size=5))
def test_decoding_is_lossless(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    s = lattice.Sampler(V)
    ids = s.sample(texts, np.arange(len(texts)))
    assert [lattice.decode(V, x) for x in ids] == texts
    # the draw depends on the row's seed alone
    assert s.sample(texts[::-1], np.arange(len(texts))[::-1])[::-1] == ids


def test_batches_do_not_change_results(monkeypatch):
    texts = [f"some words  number {i} é▁日\n" for i in range(200)]
    ids, lp = lattice.Sampler(V).sample(texts, np.arange(200)), lattice.Marginals(V).texts(texts)
    monkeypatch.setattr(lattice, "BATCH_CHARS", 100)
    monkeypatch.setattr(lattice, "MOST_SEGMENTS", 10)
    m = lattice.Marginals(V)
    assert lattice.Sampler(V).sample(texts, np.arange(200)) == ids and np.allclose(m.texts(texts), lp)
    assert len(m) < 60
    long = "x" * 3000 + " " * 40 + "y\n" * 50
    assert lattice.decode(V, lattice.Sampler(V).sample([long], np.array([1]))[0]) == long


TEXTS = [(0, None), (1, ""), (2, "Hello  World"), (2, "Hello  World"), (None, "no id"), (5, "a b c " * 4000), (6, "▁x\x00é\n")] + [(i, f"the word w{i % 7} and rare{i}") for i in range(10, 60)]


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in TEXTS], "doc_id long, text string, n_pieces int")
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(((r.text or ""), r.decoded) for r in rows) == sorted(((t or ""), (t or "")) for _, t in TEXTS)
    again = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs.repartition(3)).collect()}
    assert all(again[r.doc_id, r.text] == r.ids for r in rows)
    assert pieces.decode(pieces.encode(docs.limit(0))).collect() == []
    want = {(r.doc_id, zlib.crc32(r.ids), r.n_pieces, hashlib.sha256(r.decoded.encode()).hexdigest(), True) for r in rows}
    assert {(r.doc_id, r.ids_crc32, r.n_pieces, r.decoded_sha256, r.lossless) for r in pieces.round_trip(docs).collect()} == want


def test_very_long_texts_are_taken_in_parts(monkeypatch):
    text = " ".join(rare(i) for i in range(3000)) + "z" * 2000
    whole, ids = lattice.Marginals(V).text(text), lattice.Sampler(V).sample([text], np.array([5]))
    sizes = []
    monkeypatch.setattr(lattice, "Lattices", lambda v, s, make=lattice.Lattices: sizes.append(sum(map(len, s))) or make(v, s))
    monkeypatch.setattr(lattice, "BATCH_CHARS", 1000)
    assert abs(lattice.Marginals(V).text(text) - whole) < 1e-6 * abs(whole)
    assert lattice.Sampler(V).sample([text], np.array([5])) == ids and lattice.decode(V, ids[0]) == text
    assert len([x for x in sizes if x > 1000]) == 2  # the long word alone, scored once and sampled once


def rare(i):
    return "".join(chr(97 + (i * 7919 + k * k * 31) % 26) for k in range(3 + i % 7))


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_base_scores(spark, hot):
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in TEXTS], "doc_id long, text string, score double")
    from pyspark.sql import functions as F

    train = docs.where(~scoring.held_out(F.col("doc_id")))
    got = scoring.score(docs, train, hot=hot).collect()
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    count = Counter()
    for k, t in TEXTS:
        if k is None or zlib.crc32(str(k).encode()) % 10:
            count.update([*low(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for k, t in TEXTS:
        w = [*low(t), None]
        want.append((k if k is not None else -1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6), round(lattice.Marginals(V).text(t), 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_score_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scoring.score(docs, docs).collect() == []
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    r = scoring.score(one, docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0


def test_likely_text_scores_higher():
    m = lattice.Marginals(V)
    assert m.text("the house and the street") > m.text("xq zvv kkj wwp qqz ttrr")


@given(st.text("ab \n\r\t\0\u2581é", max_size=20))
@settings(max_examples=2000, deadline=None)
def test_quick_cuts_are_those_of_the_pattern(text):
    assert lattice.segments(text) == (lattice.SEGMENT.findall(" " + text) if text else [])


@pytest.mark.parametrize("most", [1, 5, 1 << 16, 70_000, 1 << 20])
def test_radix_order_is_the_stable_order(most):
    x = np.random.default_rng(most).integers(0, most, 50_000)
    assert (lattice.stable_order(x) == np.argsort(x, kind="stable")).all()
    assert lattice.stable_order(x[:0]).size == 0


def test_expected_counts_are_those_of_all_segmentations():
    texts, times = ["in the", "é▁", "x", "日a"], np.array([3.0, 1.0, 2.0, 5.0])
    segs = [s for t in texts for s in lattice.segments(t)]
    n = np.array([k for t, k in zip(texts, times) for _ in lattice.segments(t)])
    want, spelled = Counter(), 0.0
    for s, k in zip(segs, n):
        ways = segmentations(s)
        total = sum(math.exp(lp) for _, lp in ways)
        for ids, lp in ways:
            for i in ids:
                if i in V.byte_ids:
                    spelled += k * math.exp(lp) / total
                else:
                    want[i] += k * math.exp(lp) / total
    piece, count, more = lattice.Lattices(V, segs).expected(n)
    assert set(piece.tolist()) == set(want) and all(abs(want[i] - c) < 1e-9 for i, c in zip(piece.tolist(), count)) and abs(more - spelled) < 1e-9


def test_weights_are_learned_from_training_rows(spark):
    """On held-out rows the score comes near the base score and stays finite; the probabilities sum to 1."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ciónq", "ß", "ou", "qx"]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(400)] + [(None, None), (900, ""), (901, "日本" * 50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    out = scoring.held_out(F.col("doc_id"))
    counted = scoring.count_segments(docs.where(~out))
    w = scoring.learn(counted)
    v = V.weighted(w)
    total = sum(math.exp(x) for _, x in v.pieces.values()) + 256 * math.exp(w.byte) + math.exp(w.end) + sum(map(math.exp, w.whole.values()))
    assert abs(total - 1) < 1e-9 and " th" in w.whole
    rows = scoring.score(docs, docs.where(~out), weights=w, counted=counted).withColumn("out", out).collect()
    own = scoring.score(docs, docs.where(~out)).withColumn("out", out).collect()
    mean = lambda rows, c: sum(r[c] for r in rows if r.out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows) and len(rows) == 403
    assert mean(rows, "score") > 1.2 * mean(rows, "base_score") and mean(own, "score") < 1.8 * mean(own, "base_score")
    few = scoring.learn(counted, most=0, rounds=3)
    assert few.whole == {} and mean(scoring.score(docs, docs.where(~out), weights=few).withColumn("out", out).collect(), "score") > 0.8 * mean(own, "score")
    assert scoring.learn(scoring.count_segments(docs.limit(0))) is None


def test_words_are_counted_by_segments(spark):
    docs = spark.createDataFrame(TEXTS + [(70, "A\ta b\r\nB  c\x0b\x0cC \n"), (71, " \n ")], "doc_id long, text string")
    count = lambda df: {(bytes(r.word) if r.word is not None else None): r.c for r in df.collect()}
    assert count(scoring.words_of_segments(scoring.count_segments(docs))) == count(scoring.word_counts(docs))
