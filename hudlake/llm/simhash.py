"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is 64 bits: the majority vote, bit by bit, of the XXH64 hashes of a text's word
shingles. Two fingerprints link when at most ``RADIUS`` bits differ.

Candidate search is *covering*: bit ``i`` of the fingerprint gets a nonzero label ``phi(i)`` of
``radius + 1`` bits, and table ``v`` (a nonzero vector of ``radius + 1`` bits) keeps the bits whose
label has odd inner product with ``v``. The labels of at most ``radius`` differing bits span at most
``radius`` dimensions, so some ``v`` is orthogonal to all of them, and the two fingerprints agree on
every bit that table keeps: no pair within the radius is missed. With radius 2 that is 7 tables.

Inside a table's bucket no pairs are formed. Members of a bucket can only differ in the bits the
table dropped, so each member is sent to the points of its unit ball along those bits; two members
lie within two bits of each other exactly if they meet at a point. Each meeting point links its
members to its smallest member, so a bucket of n fingerprints costs O(n) rows whatever its size.
Equal fingerprints are collapsed first, so copies never multiply.

Defined cases: a null text has no words, like an empty one; no words give fingerprint zero, which
links like any other; fewer words than a shingle give one shingle of all words; repeated rows each
get a row; rows of a null id get a fingerprint but cannot be named as a component; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared

RADIUS = 2
BITS = 64
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit masks of the covering tables, for fingerprints of so many bits."""
    labels = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [
        sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long. Shingle hashes are made by Spark's
    xxhash64, whose seed is 42; only their bits are counted in Python."""
    words = F.filter(
        F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""
    )
    keep = [c for c in docs.columns if c != text]
    hashed = docs.select(*keep, words.alias("_w")).select(
        *keep,
        F.expr(
            f"CASE WHEN size(_w) = 0 THEN cast(array() AS array<bigint>) WHEN size(_w) < {shingle} "
            f"THEN array(xxhash64(array_join(_w, ' '))) ELSE transform(sequence(1, size(_w) - {shingle - 1}), "
            f"i -> xxhash64(concat_ws(' ', {', '.join(f'_w[i + {k - 1}]' for k in range(shingle))}))) END"
        ).alias("_h"),
    )
    target = hashed.drop("_h").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            h = batch.column(batch.num_columns - 1)
            ends = h.offsets.to_numpy()
            flat = h.values.to_numpy(zero_copy_only=False)
            fp = np.fromiter((majority(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])), "i8", len(ends) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], schema=arrow)

    return shared.map_arrow(hashed, run, target)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted 4096 hashes at a time so that memory is bounded."""
    count = np.zeros(64, "i8")
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view("u1").reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="i8")
    return np.packbits(2 * count > len(hashes), bitorder="little").view("i8")[0]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` of ``prints`` as links within the radius do."""
    if radius != 2:
        raise ValueError("meeting points of unit balls decide a radius of 2")
    tables = masks(radius)
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(tables)
    ])).alias("t")).select("fp", "t.k", "t.key")
    crowded = keyed.groupBy("k", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    # Buckets of a single fingerprint go; the others are opened along the bits their table dropped.
    members = keyed.join(crowded.select("k", "key"), ["k", "key"]).select("k", "fp").distinct()
    balls = F.array(*[
        F.when(F.col("k") == k, F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]))
        for k, m in enumerate(tables)
    ])
    points = members.select("fp", "k", F.explode(F.element_at(balls, F.col("k") + 1)).alias("d")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("d")).alias("point")
    ).distinct()
    tops = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b")
    return points.join(tops.select("point", "a"), "point").where("fp != a").select(
        F.col("fp").alias("u"), F.col("a").alias("v")
    ).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links of fingerprints."""
    prints = shared.stage(fingerprints(docs.select(key, text), text), "prints")
    distinct = shared.stage(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    groups = shared.stage(shared.components(links(distinct)), "groups")
    named = distinct.join(groups, distinct.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
