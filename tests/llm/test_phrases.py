import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hudlake.llm import phrases, queries, shared, slots

SF = "/root/testdata/sf0.001"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least=30, longest=4, absorbed=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if a >= least}
        found = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            around = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= absorbed * a for b in around):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_slots_are_minimal_and_other_keys_have_none():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 100_000):
        x, y = rng.integers(0, 1 << 63, n, dtype="u8"), rng.integers(0, 3, n, dtype="u8")
        table = slots.SlotTable(x, y)
        assert sorted(table.slots(x, y)) == list(range(n))
        order = rng.permutation(n)
        assert (slots.SlotTable(x[order], y[order]).slots(x, y) == table.slots(x, y)).all()  # the set decides, not its order
        assert (table.slots(x + np.uint64(1), y) == -1).all() and (table.slots(x, y + np.uint64(7)) == -1).all()
    with pytest.raises(ValueError):
        slots.SlotTable(np.array([5, 5]), np.array([1, 1]))


def test_counts_add_up_in_a_tree(spark):
    rng = np.random.default_rng(2)
    arrays = [(at, part, rng.integers(0, 1 << 40, 50)) for part in range(70) for at in (0, 50, 100) if (part + at) % 4]
    want = Counter()
    for at, _, c in arrays:
        for i, v in enumerate(c.tolist()):
            want[at + i] += v
    df = spark.createDataFrame([(a, p, c.astype("<i8").tobytes()) for a, p, c in arrays], slots.ARRAYS)
    assert {r.slot: r.f for r in slots.added(df, fan=4).collect()} == want
    assert slots.added(df.limit(0)).collect() == []


def sample_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünd", "ÄB", "a b", "x\x1fy", "ABC"]
    rows = []
    for i in range(300):
        words = [vocabulary[j] for j in rng.zipf(1.4, 25) % len(vocabulary)]
        text = " ".join(words) + rng.choice([". ", "\t", "\n", ";  ", "? "]) + "New York City  is\tnew york city!New York; City a a a a a"
        rows.append((text, [None, "und", "en", "de"][i % 4]))
    rows += [(None, "en"), ("", None), ("   .\n", "fr"), ("only once here", "es"), ("big apple " * 4000, "en")] + [("same row twice", "en")] * 40
    return rows


@pytest.mark.parametrize("limits", [{}, {"PART_KEYS": 7}])
def test_against_brute_force(spark, monkeypatch, limits):
    """Also with many slot tables, which tasks go through one after another, and with small buffers."""
    rows = sample_rows()
    for name, v in limits.items():
        monkeypatch.setattr(slots, name, v)
        monkeypatch.setattr(phrases, "SEEN", 50)
        monkeypatch.setattr(phrases, "ROW_WORDS", 100)
        monkeypatch.setattr(phrases, "MEMO_WORDS", 20)
        monkeypatch.setattr(slots, "CHUNK", 16)
    docs = spark.createDataFrame([(t, k, 1, "n") for t, k in rows], "text string, lang string, slot int, n string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == brute(rows) and len({r[0] for r in got}) == 3
    assert sorted(map(tuple, phrases.collocations(docs, least=5, longest=5, absorbed=60, most=10).collect())) == brute(rows, 5, 5, 60, 10)


def test_counts_by_slot_are_those_of_the_candidates(spark):
    docs = spark.createDataFrame(sample_rows(), "text string, lang string")
    levels, totals = phrases.mine(docs)
    f = Counter()
    for text, lang in sample_rows():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    for k, level in enumerate(levels, 1):
        assert {(r.lang, r.phrase): r.f for r in level.collect()} == {p: a for p, a in f.items() if a >= 30 and p[1].count(" ") == k - 1}
    assert {r.lang for r in totals.collect()} == {"und", "en", "de", "es"}  # no word, no total: fr has no row to report


def test_products_beyond_64_bits_and_ties(spark):
    """Scores of counts near 2^62, and a tie between cuts after flooring, which goes to the smallest cut."""
    big = 1 << 61
    one = spark.createDataFrame([(0, "en", "a", big, [big], [big], -1, -1)], "slot long, lang string, phrase string, f long, begins array<long>, rests array<long>, pre long, ends long")
    three = spark.createDataFrame([(0, "en", "a b c", 40, [41, 42, 40], [40, 50, 51], 0, 0)], one.schema)
    two = spark.createDataFrame([(0, "en", "a b", big - 3, [big, big - 3], [big - 3, big - 1], 0, 0), (1, "en", "t u", 10, [30_000_000, 10], [10, 1], 0, 0)], one.schema)
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases.scored([one, two, three]).collect()}
    assert got["a b"] == (2000000 * (big - 3) // (2 * big - 1), big, big - 1)
    assert got["a b c"] == (2000000 * 40 // 93, 42, 51)
    tie = spark.createDataFrame([(0, "en", "x y z", 1, [8, 7, 1], [1, 8, 9], 0, 0)], one.schema)
    assert phrases.scored([one, two.limit(0), tie]).first().l == 8


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_query_against_sql_and_brute_force(spark):
    got = queries.QUERIES["op13_phrase_collocations"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = brute(zip(docs.text, docs.lang))
    assert sorted(got.itertuples(index=False, name=None)) == want and len(want) > 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(queries.ORACLES["op13_phrase_collocations"]).df()[list(got.columns)]
    assert sorted(sql.itertuples(index=False, name=None)) == want
