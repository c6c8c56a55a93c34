import random
from collections import Counter, defaultdict

import numpy as np
from hudlake.llm import packing, shared, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def optimum(items, capacity):
    """Fewest bins by trying everything."""
    best = len(items)
    items = sorted(items, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(items):
    fixed, rest = packing.reduce_exactly(Counter(items), 20)
    used = Counter(rest)
    for pattern, many in fixed:
        assert sum(pattern) <= 20
        for s in pattern:
            used[s] += many
    assert used == Counter(items)
    bins = sum(m for _, m in fixed) + optimum(list(Counter(rest).elements()), 20)
    assert bins == optimum(items, 20)
    assert packing.lower_bound(Counter(items), 20) <= optimum(items, 20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_places_every_item(items):
    plan = packing.plan(Counter(items), 50)
    used = Counter()
    for pattern, many in plan:
        assert sum(pattern) <= 50 and many > 0
        for s in pattern:
            used[s] += many
    assert used == Counter(items)


def test_best_fit_on_counts_is_best_fit_on_items():
    rng = random.Random(1)
    for _ in range(200):
        items = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 80))), reverse=True)
        rooms = []
        for x in items:
            fits = [k for k, r in enumerate(rooms) if r >= x]
            if fits:
                k = min(fits, key=lambda k: rooms[k])
                rooms[k] -= x
            else:
                rooms.append(40 - x)
        got = packing.best_fit(Counter(items), 40)
        assert sorted(40 - sum(p) for p, m in got for _ in range(m)) == sorted(rooms)


def test_documents_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    rng = random.Random(2)
    texts = [None, "", "x", "y " * 2047, "y " * 2048, "z " * 9000] + ["w " * rng.randint(0, 900) for _ in range(60)] + ["same"] * 30
    docs = spark.createDataFrame([(i if i % 9 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    staged = shared.stage(packing.pieces(docs), "pieces")
    rows = packing.pack(staged).collect()
    enc = tokens.Encoder().tokenizer
    assert sum(r.length for r in rows) == sum(len(enc.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for got in by.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= 2048
    counts = Counter(r.length for r in rows)
    assert len(by) <= 1.05 * packing.lower_bound(counts, 2048) + 1
    for d in (5, 3, 4):
        whole = np.array([*enc.encode(texts[d], add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == d)
        assert b"".join(x[3] for x in mine) == whole
        assert all(x[2] == 2048 for x in mine[1:]) and [x[1] for x in mine] == np.cumsum([0, *(x[2] for x in mine)])[:-1].tolist()
    whole = packing.sequences(packing.pack(staged)).collect()
    assert sorted(len(r.ids) // 4 for r in whole) == sorted(sum(n for _, n in g) for g in by.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(shared.stage(packing.pieces(docs), "pieces")).collect() == []


def test_rows_that_repeat_are_ranked_by_many_tasks(spark):
    """20,000 rows alike in all columns have different places, so their salts differ; packing stays whole."""
    rows = spark.range(20_000).selectExpr("7 AS doc_id", "0 AS piece", "cast(0 AS long) AS start", "cast(1000 AS long) AS length", "'x' AS _metadata")
    for items in (shared.stage(rows.drop("_metadata"), "items"), rows):
        salts = shared.with_place(items, "place").groupBy(F.pmod("place", F.lit(20))).count().collect()
        assert len(salts) == 20 and max(r["count"] for r in salts) < 1300
    packed = packing.pack(shared.stage(rows.drop("_metadata"), "items"))
    places = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect()
    assert packed.count() == 20_000 and len(places) == 10_000 and all(r.o == [0, 1000] for r in places)
