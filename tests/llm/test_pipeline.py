"""The pipeline over a small corpus with planted documents, stage by stage, against plain versions."""

import random

import corpus_pipeline as P
import pytest
from hudlake.llm import quality, shared, simhash, tokens, toxicity

from tests.llm.test_simhash import brute, groups

rng = random.Random(8)
BITS = ["an", "the", "re", "on", "st", "ing", "ou", "er", "ti", "ha"]
word = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(1, 5)))
say = lambda n: " ".join(word() for _ in range(n))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts, toxic, bad = {}, set(), set()
    for i in range(260):
        texts[i] = "\n".join(say(rng.randint(20, 60)) + "." for _ in range(3))
        if i % 6 == 0:
            words = texts[i].split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "zorgful", "mukking"]))
            texts[i] = " ".join(words)
            toxic.add(i)
        elif i % 10 == 1:
            texts[i] = " ".join(w + "%%%" for w in texts[i].split(" "))
            bad.add(i)
    passage = say(64)
    for i in (302, 303, 304):
        texts[i] = f"{say(50)} {passage} {say(50)}"
    texts |= {300: texts[2], 301: texts[2], 305: None, 306: "", 307: "same " * 80, 308: say(700)}
    folder = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "src", len(t or "")) for k, t in texts.items()] + [(None, say(60), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, toxic, bad, passage


def test_stages(spark, corpus):
    folder, texts, toxic, bad, passage = corpus
    docs = shared.table(spark, folder, "documents")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]

    one = shared.stage(stages["toxicity"](spark, docs, folder), "one")
    assert one.columns == docs.columns
    model = toxicity.train(docs, shared.table(spark, folder, "labels"))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
    kept = {r.doc_id for r in one.collect()}
    assert kept == want and None in kept
    held = {i for i in toxic if i in kept}
    assert len(held) <= 2 and len([i for i in range(260) if i not in toxic and i not in kept]) <= 2

    two = shared.stage(stages["quality_rules"](spark, one, folder), "two")
    assert two.columns == docs.columns
    after = {r.doc_id for r in two.collect()}
    for k in kept - {None}:
        s = quality.text_statistics(texts[k])
        if s[0] < 20 or 100 * s[4] > 30 * s[0]:
            assert k not in after
    assert not {305, 306, 307} & after and not bad & after
    assert len(kept - after - bad - {305, 306, 307}) <= 3 and None in after

    three = shared.stage(stages["simhash_near_dedup"](spark, two, folder), "three")
    assert three.columns == docs.columns
    prints = {k: brute(texts[k]) for k in after - {None}}
    assert {r.doc_id for r in three.collect()} - {None} == {min(i for i, g in groups(prints).items() if g == c) for c in set(groups(prints).values())}

    four = shared.stage(stages["substring_dedup"](spark, three, folder), "four")
    assert four.columns == docs.columns
    left = {r.doc_id: r for r in four.collect()}
    assert [passage in left[k].text for k in (302, 303, 304)] == [True, False, False]
    assert all(left[k].text == texts[k] for k in left if k is not None and k not in (303, 304)) and all(r.n_chars == len(r.text) for r in left.values() if r.n_chars is not None)

    rows = stages["best_fit_packing"](spark, four, folder).collect()
    enc = tokens.Encoder()
    assert sum(r.length for r in rows) == sum(len(enc.encode(r.text)) // 4 + 1 for r in left.values())
    assert {r.doc_id for r in rows} == set(left)


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    assert P.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_leave_one(spark, corpus):
    text = say(90)
    docs = spark.createDataFrame([(1, text, "en", "a", 3), (1, text, "en", "a", 3), (1, text, "fr", "b", 3)], SCHEMA)
    assert P.drop_near_duplicates(spark, docs, corpus[0]).count() == 1


def test_simhash_keys_of_hashes():
    assert simhash.signed(1 << 63) == -(1 << 63)


def test_near_documents_leave_one(spark, corpus):
    """Edited copies of five-word similarity 0.8 and more go, less similar ones stay, against all pairs by brute force."""
    texts = {}
    for g in range(20):
        base = say(200).split()
        for k, edits in enumerate((0, 1, 3, 12, 40)):
            words = list(base)
            for i in rng.sample(range(200), edits):
                words[i] = f"edit{g}x{k}x{i}"
            texts[10 * g + k] = " ".join(words)
    texts |= {500: "one two", 501: "One  two", 502: "two one", 503: None, 504: ""}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = {k: shingles((t or "").lower().split()) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            same = (texts[a] or "").lower().split() == (texts[b] or "").lower().split()
            if root[a] != root[b] and (same or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    docs = spark.createDataFrame([(k, t, "en", "a", 3) for k, t in texts.items()], SCHEMA)
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, corpus[0]).collect()} == set(root.values())
    assert len(set(root.values())) < len(texts) - 40


def test_clashing_columns_go_through(spark, corpus, tmp_path):
    """Columns named like the stages' own, a map, null ids, repeated rows and a very long text come out as they went in."""
    folder, texts, *_ = corpus
    long = say(60_000)
    schema = SCHEMA + ", score double, _row long, _n long, _rid long, _spans long, _whole long, spare map<string,long>"
    extra = (0.5, 1, 2, 3, 4, 5, {"k": 1})
    rows = [(k, t, "en", "src", len(t or ""), *extra) for k, t in texts.items()]
    rows += [(None, texts[3], None, None, None, *extra)] * 3 + [(900, long, "en", "src", len(long), *extra)] * 2
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all((r.score, r._row, r._n, r._rid, r._spans, r._whole, r.spare) == extra for r in got)
        assert all(r.text == long for r in got if r.doc_id == 900)
        if name == "simhash_near_dedup":
            assert sum(r.doc_id == 900 for r in got) == 1 and sum(r.text == texts[3] for r in got) == 1
        if name == "substring_dedup":  # the null id comes first and keeps its text
            assert sum(r.doc_id == 900 for r in got) == 2 and [r.text for r in got if r.doc_id is None] == [texts[3]] * 3
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows_of(docs)}


def rows_of(df):
    return df.select("doc_id").collect()
