"""Near-duplicate embeddings by cross-polytope hashing with multiprobe.

A hash rotates a vector pseudo-randomly, by three rounds of random signs and a fast Hadamard
transform, and names the axis, with its sign, that the rotated vector lies closest to. A table's key
joins ``HASHES`` of them. A vector lives in its own bucket and also visits, for each hash of the key,
the bucket in which that hash takes its runner-up axis. Vectors that meet, one of them at home, are
candidates, and each candidate pair's cosine is computed in double precision.

Equal vectors are collapsed to one with a count before anything else. Buckets are compared as
matrices, ``BLOCK`` members at a time, and a larger bucket is cut into blocks whose pairs are compared
by different tasks. No pairs leave a comparison: a task reports, per member, the copies it links to
that it met here for the first time (an earlier table's meeting is recognised from the keys that
members carry), and one edge to the smallest member of its local component. So a group of near copies
costs rows in proportion to its members for each block it is compared with.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and vectors of
null label or null id, link with nothing; vectors of different lengths do not link; repeated rows are
copies of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared

COSINE = 0.93
TABLES, HASHES = 8, 3
BLOCK = 512
SEED = 5


@cache
def signs(dim: int, table: int, k: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, table, k)).choice([-1.0, 1.0], size=(3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h, out = x.shape[1], 1, x
    while h < n:
        y = out.reshape(len(x), n // (2 * h), 2, h)
        out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return out / np.sqrt(n)


def keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home key of each row and table, shape (rows, TABLES), and visited keys, (rows, TABLES, HASHES)."""
    width = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    home, visits = np.zeros((len(x), TABLES), "i8"), np.zeros((len(x), TABLES, HASHES), "i8")
    rows = np.arange(len(x))
    for t in range(TABLES):
        best, second = np.zeros((len(x), HASHES), "i8"), np.zeros((len(x), HASHES), "i8")
        for k in range(HASHES):
            y = padded
            for s in signs(width, t, k):
                y = hadamard(y * s)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            swap = np.abs(y[rows, top[:, 0]]) < np.abs(y[rows, top[:, 1]])
            top[swap] = top[swap][:, ::-1]
            for into, col in ((best, 0), (second, 1)):
                into[:, k] = 2 * top[:, col] + (y[rows, top[:, col]] < 0)
        base = (2 * width) ** np.arange(HASHES)
        home[:, t] = best @ base
        visits[:, t] = home[:, t, None] + (second - best) * base
    return home, visits


def usable() -> F.Column:
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0), F.lit(False)
    )


def hashed(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, dim, copies, raw, x, home, visits) of distinct usable vectors; x has length 1."""
    distinct = vectors.where(usable()).groupBy("label", F.col("embedding").cast("array<double>").alias("x")).agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")
    )

    def make():
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40

        def work(columns):
            nonlocal n
            label, raw, vec, copies = columns
            dims = np.array([len(r) for r in raw], "i4")
            out = {"rid": list(range(n, n + len(raw))), "vec_id": vec, "label": label, "dim": dims, "copies": copies}
            unit, home, visits = [None] * len(raw), [None] * len(raw), [None] * len(raw)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x = np.array([raw[i] for i in mine])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                h, v = keys(x)
                for i, a, b, c in zip(mine, x, h, v.reshape(len(x), -1)):
                    unit[i], home[i], visits[i] = a, b, c
            n += len(raw)
            return out | {"raw": raw, "x": unit, "home": home, "visits": visits}

        return work

    return shared.map_rows(
        distinct.select("label", "x", "vec_id", "copies"), make,
        "rid long, vec_id long, label int, dim int, copies long, raw array<double>, x array<double>, home array<long>, visits array<long>",
    )


def met_before(t: int, ha: np.ndarray, va: np.ndarray, hb: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """Whether pairs of members meet in a table before ``t``; home (pairs, TABLES), visits (pairs, TABLES, HASHES)."""
    out = np.zeros(len(ha), bool)
    for e in range(t):
        out |= (ha[:, e] == hb[:, e]) | (va[:, e] == hb[:, e, None]).any(1) | (vb[:, e] == ha[:, e, None]).any(1)
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member reachable over the pairs (a, b), for each of n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(t: int, rid, at_home, chunk, copies, x, home, visits, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of one comparison, sorted by rid: copies linked here first, and the local root of each.

    With two chunks only pairs across them count. A pair meets if one of the two is at home; where
    each also visits the other's home, the bucket of the smaller rid counts it.
    """
    n = len(rid)
    g = x @ x.T >= cosine
    g &= at_home[:, None] | at_home[None, :]
    if chunk.min() != chunk.max():
        g &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(np.triu(g, 1))
    first = ~met_before(t, home[a], visits[a], home[b], visits[b])
    apart = home[a, t] != home[b, t]
    mutual = apart & (visits[a, t] == home[b, t, None]).any(1) & (visits[b, t] == home[a, t, None]).any(1)
    first &= ~(mutual & ~at_home[a])  # rid ascends, so a has the smaller one
    links = np.bincount(a, weights=copies[b] * first, minlength=n) + np.bincount(b, weights=copies[a] * first, minlength=n)
    return links.astype("i8"), local_roots(n, a, b)


def meetings(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rid, links, root) reports of all comparisons of staged ``hashed`` vectors."""
    t = F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("t")
    spots = vectors.select("rid", "label", "dim", "home", "visits", t).select(
        "rid", "label", "dim", "t",
        F.explode(F.concat(
            F.array(F.struct(F.element_at("home", F.col("t") + 1).alias("key"), F.lit(True).alias("at_home"))),
            F.transform(F.slice("visits", F.col("t") * HASHES + 1, HASHES), lambda k: F.struct(k.alias("key"), F.lit(False).alias("at_home"))),
        )).alias("s"),
    ).select("rid", "label", "dim", "t", "s.key", "s.at_home")
    place = ["label", "dim", "t", "key"]
    crowded = spots.groupBy(*place).agg(F.count("*").alias("n"), F.max("at_home").alias("h")).where("n > 1 AND h").select(*place, "n")
    chunks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    members = spots.join(crowded, place).withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select(
        "rid", *place, "at_home", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")
    )
    carried = vectors.select("rid", "copies", "x", "home", "visits")

    def run(group):
        import pyarrow as pa

        group = group.sort_by("rid")
        col = lambda name: group.column(name).to_numpy()
        n = group.num_rows
        flat = lambda name: group.column(name).combine_chunks().flatten().to_numpy().reshape(n, -1)
        rid = col("rid")
        links, root = compare(
            int(group.column("t")[0].as_py()), rid, col("at_home"), col("chunk"), col("copies"), flat("x"), flat("home"),
            flat("visits").reshape(n, TABLES, HASHES), cosine,
        )
        some = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"rid": rid[some], "links": links[some], "root": rid[root[some]]})

    return members.join(carried, "rid").groupBy(*place, "a", "b").applyInArrow(run, "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    vectors = vectors.select("vec_id", "label", "embedding")
    distinct = shared.stage(hashed(vectors), "vectors")
    found = shared.stage(meetings(distinct, cosine), "meetings")
    groups = shared.stage(shared.components(found.select("rid", "root"), "rid", "root"), "groups")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = distinct.select("rid", "vec_id", "label", "copies", "raw").join(links, "rid", "left").join(
        groups.withColumnRenamed("node", "rid"), "rid", "left"
    ).withColumn("root", F.coalesce("component", "rid"))
    firsts = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = named.join(firsts, "root").select(
        "label", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = usable()
    same = vectors.where(good).withColumn("raw", F.col("embedding").cast("array<double>")).join(named, ["label", "raw"])
    rest = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return same.select("vec_id", "n_links", "component_id").union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))
