import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hudlake.llm import codes, queries

SF = "/root/testdata/sf0.001"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd rounds in Python's integers over rows (id, label, vector)."""
    kept = [r for r in rows if r[2] and all(v is not None and math.isfinite(v) for v in r[2])]
    if not kept:
        return [], None, []
    width = -(-max(len(v) for _, _, v in kept) // parts)
    x = np.array([[min(max(math.floor(c * scale) if abs(c) < 2**53 else int(c) * scale, -(1 << 62)), 1 << 62) for c in v] + [0] * (parts * width - len(v)) for _, _, v in kept], "O").reshape(-1, parts, width)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [x[order, p] for p in range(parts)]

    def assign():
        out = []
        for p, book in enumerate(books):
            d = ((x[:, p, None] - book[None]) ** 2).sum(2)
            e = [int(np.argmin(r)) for r in d]
            out.append((e, [int(r[i]) for r, i in zip(d, e)]))
        return out

    for _ in range(rounds):
        for p, (e, _) in enumerate(assign()):
            book = books[p].copy()
            for i in set(e):
                mine = x[[j for j, k in enumerate(e) if k == i], p]
                book[i] = mine.sum(0) // len(mine)
            books[p] = book
    last = assign()
    code = ["".join(f"{last[p][0][i]:02x}" for p in range(parts)) for i in range(len(kept))]
    error = [min(sum(last[p][1][i] for p in range(parts)), (1 << 63) - 1) for i in range(len(kept))]
    return [(r[0], r[1], c, e) for r, c, e in zip(kept, code, error)], books, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


SCHEMA = "vec_id long, label int, embedding array<float>"


def rows_of(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(int(k), int(k) % 5, np.float32(centres[rng.integers(12)] + spread * rng.normal(size=width)).tolist()) for k in rng.permutation(n) * 3]


def run(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema).repartition(3)
    out, books, compared = codes.compress(df, **how)
    return sorted(map(tuple, out.collect()), key=repr), books, compared


@pytest.mark.parametrize("block", [codes.BLOCK_BYTES, 1000])
def test_heap_rounds_are_those_of_plain_lloyd(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK_BYTES", block)
    rows = rows_of(700, 16, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # blocks gather rows of several batches
    for how in ({}, {"entries": 20, "rounds": 9}, {"parts": 2, "entries": 5, "rounds": 3, "scale": 7}):
        got, books, compared = run(spark, rows, **how)
        want, want_books, digest = plain(rows, **how)
        assert got == sorted(want, key=repr) and codes.signature(books) == digest
        parts = how.get("parts", 4)
        assert compared[0] == 700 * parts and sum(compared[1:]) < 700 * parts * (len(compared) - 1)  # heaps spare comparisons


@pytest.fixture(autouse=True)
def batches(spark):
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_later_rounds_compare_few_parts(spark):
    """Well parted clusters: once entries stand still, nothing is popped."""
    rows = rows_of(900, 8, 2, spread=0.01)
    _, _, compared = run(spark, rows, entries=12, rounds=8)
    assert compared[0] == 3600 and compared[-1] < 0.3 * 3600


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(40, 8, 3) + [(1000, None, None), (1001, 1, []), (1002, 1, [1.0, nan] * 4), (1003, 1, [inf] * 8), (1004, 1, [None] + [1.0] * 7), (1005, None, [0.0] * 8)]
    rows += [(None, None, [0.25] * 8), (1006, 2, [0.5] * 3), rows[0], rows[0], (rows[1][0], 9, [9.0] * 8), (1007, 3, [1.0] * 5)]
    got, books, _ = run(spark, [(*r, "x", 1.5) for r in rows], SCHEMA + ", code string, error double")
    want, _, digest = plain(rows)
    assert got == sorted(want, key=repr) and codes.signature(books) == digest and len(books[0]) == len(got) == 47
    few, _, _ = run(spark, rows, entries=4)
    assert few == sorted(plain(rows, entries=4)[0], key=repr)
    odd = rows_of(30, 10, 4)  # a width that 4 does not divide is filled up with zeros
    assert run(spark, odd, entries=6)[0] == sorted(plain(odd, entries=6)[0], key=repr)
    assert codes.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    assert codes.compress(spark.createDataFrame([(1, 1, None)], SCHEMA))[0].collect() == []


@pytest.mark.parametrize("factor", [1e4, 3e5, 1e7, 1e12, 1e18])
def test_exact_at_any_size(spark, factor):
    """Doubles, 64-bit integers, Python's integers; sums of one and of two limbs."""
    rows = [(k, n, [v * factor for v in x]) for k, n, x in rows_of(60, 8, 5)]
    schema = SCHEMA.replace("float", "double")
    got, books, _ = run(spark, rows, schema, entries=10, rounds=3)
    want, _, digest = plain(rows, entries=10, rounds=3)
    assert got == sorted(want, key=repr) and codes.signature(books) == digest
    rows = [(1, 1, [1e300, -1e308, 0.0, 1.0]), (2, 1, [5.0, 1.0, 1.0, 1.0])]
    assert run(spark, rows, schema, entries=1)[0] == sorted(plain(rows, entries=1)[0], key=repr)


def test_ties_go_to_the_lower_entry(spark):
    same = [0.5] * 8
    rows = [(k, 1, same) for k in range(6)] + [(k, 1, [0.0] * 8) for k in range(6, 9)] + [(9, 1, [0.25] * 8)]
    got, _, _ = run(spark, rows, entries=8, rounds=2)
    assert got == sorted(plain(rows, entries=8, rounds=2)[0], key=repr) and {r[2] for r in got[:6]} == {"01010101"}  # the first entry moves off, the unused second stays


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_query_against_plain_rounds_and_sql(spark):
    got = queries.QUERIES["op12_vector_codes"](spark, SF).toPandas().sort_values("vec_id")
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    want, _, digest = plain([(int(k), int(n), list(map(float, v))) for k, n, v in zip(table.vec_id, table.label, table.embedding)])
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    assert list(got.itertuples(index=False, name=None)) == sorted((k, c, e, by_label[n], digest) for k, n, c, e in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = con.execute(queries.ORACLES["op12_vector_codes"]).df()[list(got.columns)].sort_values("vec_id")
    assert list(sql.itertuples(index=False, name=None)) == list(got.itertuples(index=False, name=None))
