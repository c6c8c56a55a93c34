import random
import re
from collections import Counter

import numpy as np
from hudlake.llm import quality, shared
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", "x|y", "\x1c", " ", "long line here\n"]), max_size=80).map(" ".join))
def test_base_statistics(text):
    assert quality.text_statistics(text)[:5] == brute(text)


def test_long_repeats():
    assert quality.text_statistics("a " * 5000)[4] == 5000
    assert quality.text_statistics(None)[:5] == (0, 0, 0, 0, 0)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    f = quality.Forest(x)
    assert f.score(np.array([[9.0, 9, 9]]))[0] > f.score(x).max() - 0.05 > f.score(np.zeros((1, 3)))[0]


def test_calibration_keeps_good_rows():
    good = {k: 1 for k in range(1000)}
    cut = quality.calibrate(good, 0.01)
    assert sum(k > cut for k in good) <= 10 < sum(k >= cut - 1 for k in good)
    assert quality.calibrate({}) == quality.SCORE_STEPS


def test_verdicts(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("aeiou") + str(rng.getrandbits(20)) for _ in range(n))
    texts = {i: say(rng.randint(60, 200)) for i in range(300)} | {300: None, 301: "", 302: "same " * 100, 303: "%%% ### $$$ *** " + " ".join("&%$#" * 2 + str(i) for i in range(90))}
    texts[304] = texts[303] + " more"
    rows = [(k, t, "x", 5) for k, t in texts.items()] + [(None, say(80), "x", 5), (7, texts[7], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(303, 0, 0), (304, 0, 0)] + [(None, 1, 0), (9999, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    stats = shared.stage(quality.statistics(docs), "statistics")
    got = quality.judge(stats, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not any(by[k].kept for k in (300, 301, 302, 303))
    assert by[300].base_failed and by[302].base_failed and not by[303].base_failed
    assert sum(by[k].kept for k in range(300)) > 280
    no_labels = quality.judge(stats, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in no_labels)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(shared.stage(quality.statistics(docs), "statistics"), labels).collect() == []
