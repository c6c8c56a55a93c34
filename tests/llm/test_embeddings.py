import numpy as np
import pytest
from hudlake.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


def brute(rows, cosine=E.COSINE):
    ok = [
        (i, lab, np.array(e, "f8")) for i, e, lab in rows
        if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and any(e)
    ]
    links, root = {i: 0 for i, _, _ in ok}, {i: i for i, _, _ in ok}
    for a in range(len(ok)):
        for b in range(a):
            (i, la, x), (j, lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                ra, rb = root[i], root[j]
                for k in root:
                    if root[k] in (ra, rb):
                        root[k] = min(ra, rb)
    return {i: (links.get(i, 0), root.get(i, i)) for i, _, _ in rows if i is not None}


def near(rng, x, cosine):
    z = rng.normal(size=len(x))
    x = x / np.linalg.norm(x)
    z -= (z @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def clusters(rng, dim=64):
    out = []
    for c in range(40):
        x = rng.normal(size=dim)
        out.append((x, c % 3))
        for _ in range(int(rng.integers(0, 4))):
            out.append((near(rng, x, 0.96), c % 3))
            out.append((x.copy(), (c + c % 2) % 3))
    x = rng.normal(size=dim)
    out += [(near(rng, x, 0.985), 1) for _ in range(90)]
    order = rng.permutation(len(out))
    return [(int(k), out[i][0].astype("f4").tolist(), out[i][1]) for k, i in enumerate(order)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = clusters(rng)
    n = len(rows)
    some = rows[0][1]
    rows += [
        (n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [float("inf")] + [0.0] * 63, 1), (n + 4, [], 1),
        (n + 5, [None] + [1.0] * 63, 1), (n + 6, some, None), (None, some, 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, [3.0], 2), (n + 10, [1e-30] * 64, 0),
        (n + 11, [5.0] * 64, 0),
    ]
    got = E.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_at_the_threshold():
    """Share of pairs at the threshold itself, the hardest ones, that meet in some table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    y = np.array([near(rng, v, 0.9301) for v in x])
    (ha, va), (hb, vb) = E.keys(x), E.keys(y)
    assert E.met_before(E.TABLES, ha, va, hb, vb).mean() >= 0.97
    z = rng.normal(size=(2000, 64))
    (hz, vz) = E.keys(z)
    assert E.met_before(E.TABLES, ha, va, hz, vz).mean() < 0.002


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.5], 3, 0), (1, [1.0, 0.5], 3, 0), (4, [2.0, 1.0], 3, 0)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False)]
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((E.hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(E.hadamard(E.hadamard(x)), x)
