"""What the corpus operators share: shared-folder tables, Arrow maps and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.sources.tables import table  # noqa: F401 - the operators take both from here
from hudlake.staging import drop_path, drop_stage, new_path, shared_folder, stage  # noqa: F401

#: Rows, and bytes of texts, of one Arrow batch that Python turns into objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Bytes of one Arrow batch. A session whose limit is higher (Spark's own is 64 MB) is held to this one: a batch
#: lies in the JVM's direct memory and in the Python worker at once, for each core.
ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Classes of hashes by which a sample's bound is worked out.
SAMPLE_CLASSES = 1 << 12


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it; Spark compares without case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator:
    """Parts of an Arrow batch of at most ``rows`` rows, and of ``size`` bytes of texts or one row each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = np.zeros(batch.num_rows, "i8")
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(held), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def with_place(df: DataFrame, name: str = "place") -> DataFrame:
    """``df`` with a hash of each row's file and number there, alike in every scan; rows that are not read from files are staged.

    It tells rows apart that repeat in all columns, so that salts and ranges split them.
    """
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    if "_metadata" not in map(str.lower, df.columns):
        try:
            out = df.withColumn(name, place)
            out.schema  # noqa: B018 - resolves the plan
            return out
        except AnalysisException:
            pass
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    staged = stage(plain, "placed")
    return staged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], place.alias(name))


_residents: dict[str, dict] = {}


def resident(owner: str, key, make: Callable[[], object]):
    """What a Python worker keeps from task to task: ``make()``, once for each ``key`` of the module ``owner``."""
    mine = _residents.setdefault(owner, {})
    if key not in mine:
        mine[key] = make()
    return mine[key]


def vacate(owner: str) -> None:
    """Drop what modules other than ``owner`` keep in this worker: another stage runs now."""
    for other in [o for o in _residents if o != owner]:
        del _residents[other]


def give_back() -> None:
    """Memory that a task has freed goes back to the system, for its worker lives on beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema, owner: str = "") -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, by workers that keep only ``owner``'s residents and give memory back."""
    conf = df.sparkSession.conf
    held = conf.get(ARROW_LIMIT).lower()
    if not held.removesuffix("b").isdigit() or int(held.removesuffix("b")) > ARROW_BYTES:  # with another unit, set it anew
        conf.set(ARROW_LIMIT, str(ARROW_BYTES))

    def bounded(batches: Iterator) -> Iterator:
        vacate(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], dict[str, list]]], schema: str, rows: int = SLICE_ROWS, owner: str = "") -> DataFrame:
    """Run a Python function over column lists, ``rows`` rows and ``SLICE_BYTES`` of texts at a time.

    ``make`` is called once a task and returns the function, so that caches live as long as the
    task; the function gets one list per column of ``df`` and returns lists by output column.
    ``owner`` names the module whose residents the worker keeps.
    """
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        work = make()
        for batch in batches:
            for part in slices(batch, rows):
                out = work([c.to_pylist() for c in part.columns])
                arrays = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_arrow(df, run, target, owner)


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def hash_sample(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """The ``rows`` distinct rows of the smallest hash of their first ``order`` column, ties by all of them; all if there are no more.

    Repeated rows count once: else a row that repeats without end would be the whole sample. Rows are counted by the leading bits of the hash first. Those of the classes that lie wholly behind the
    ``rows``-th row cannot be chosen and are left out, so that a task has few rows to offer to the choice.
    """
    df = df.distinct()
    mixed = F.pmod(F.xxhash64(order[0]), F.lit(1 << 40))
    part = F.floor(mixed / F.lit((1 << 40) // SAMPLE_CLASSES)).cast("int")
    total, last = 0, SAMPLE_CLASSES
    for r in sorted(df.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        total += r["count"]
        if total >= rows:
            last = r["part"]
            break
    return df.where(part <= last).orderBy(mixed, *order).limit(rows)


def bounded_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    Returns (node, component) for every node with an edge to another node; component is the
    smallest node reachable. Each round is two aggregations and two joins; a hub's edges are
    reduced by partial aggregation before they move, and the join that hands the smallest
    neighbour back is an ordinary shuffle join that adaptive execution splits where it is skewed.
    Rounds are written to the shared folder, so no lineage grows, and go on until one changes nothing. Nothing
    is collected but one count and one checksum a round.
    """
    e = edges.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")
    )
    e = stage(e.distinct(), "edges")
    sign = _signature(e)
    before = None
    while sign != before:
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("x")).union(e.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("x > n").join(least, "n").where("x != m").select(F.col("x").alias("hi"), F.col("m").alias("lo"))
        large = stage(large.distinct(), "large")
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        fresh = stage(small.union(floor.select("hi", F.col("m").alias("lo"))).distinct(), "small")
        drop_stage(large, e)
        e, before, sign = fresh, sign, _signature(fresh)
    tops = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        tops.select("node", F.col("node").alias("component"))
    )


def _signature(e: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo")
    row = e.agg(F.count("*"), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(mixed, 32))).first()
    return tuple(row)
