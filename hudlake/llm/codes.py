"""Vector codes: product quantisation in exact integers, its codebooks trained by Lloyd rounds on heaps.

A vector's components become integers, and its ``parts`` equal parts get the index of the nearest entry of
their codebook each. A round assigns every part and moves every entry to the floored mean of its parts. Between
rounds most parts keep their entry, and heaps tell which ones may not: a part that was compared with all entries has an
upper bound, the distance to its own entry, and a lower bound, that to the second nearest. Entries that move by p shrink
the gap of lower minus upper bound by p of the part's own entry and the largest p of any other at most; the sum of these
over the rounds is the entry's cumulative drift. A part goes to the heap of its entry under the key gap + drift so far,
so its bounds are violated exactly when the entry's drift has reached the key. A round pops those, compares
them with all entries exactly, and pushes them again; all others are not looked at.

Vectors lie in blocks of some thousand, one row each, with the heaps of their parts. A heap is kept as an ascending
array (which is a heap): popping takes its head, pushing sorts the block's heaps anew. A round reads blocks,
writes them with their new heaps to the shared folder, and gives for each task the change of the entries' counts and sums,
which are added up in a tree; only these sums of ``parts`` x ``entries`` x width numbers reach the driver.

Distances are exact: in doubles while all terms stay below 2^53, in 64-bit integers below 2^62, else in Python's integers.
Bounds are doubles and are taken as violated ``MARGIN`` of the numbers' size too early.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped; shorter vectors are filled
up with zeros to the longest one, and that to a multiple of ``parts``; repeated rows are coded each; a null id is coded and comes
last in the order of ids; rows of equal ids are ordered by vector; with fewer vectors than entries there are as many entries as
vectors; a tie of distances goes to the lower entry; components past 2^62 after scaling count as 2^62, and errors past a long as
the largest one; null labels are one label; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared
from hudlake.llm.slots import ARRAYS, tree_sum

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bytes of integers in one block, and rows compared with a codebook at a time.
BLOCK_BYTES, RESCAN = 2 << 20, 4096
MARGIN = 1e-9
LARGEST, CLAMP = (1 << 63) - 1, 1 << 62
#: Sums that may pass 64 bits travel as two numbers, high * LIMB + low.
LIMB = 1 << 31


@dataclass(frozen=True)
class Shape:
    """What decides the arithmetic: part width, number of entries, largest magnitude, number of vectors."""

    width: int
    parts: int
    entries: int
    most: int
    rows: int

    @property
    def stored(self) -> str:
        return "<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<i8"

    @property
    def exact(self) -> str:
        """Type in which distances are exact."""
        terms = 4 * self.width * (self.most + 1) ** 2
        return "f8" if terms < 1 << 53 else "i8" if terms < 1 << 62 else "O"

    @property
    def limbs(self) -> int:
        return 1 if self.most * self.rows < CLAMP else 2

    @property
    def margin(self) -> float:
        return MARGIN * (1 + 2.0 * self.most * self.width**0.5)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), within ``CLAMP``."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    out = np.where(np.abs(y) < CLAMP, y, 0).astype("i8")
    out[y >= CLAMP], out[y <= -CLAMP] = CLAMP, -CLAMP
    return out


def nearest(x: np.ndarray, book: np.ndarray, exact: str) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and the gap between the distances of the second and of the first."""
    index, gap = np.zeros(len(x), "i8"), np.full(len(x), np.inf)
    c = book.astype(exact)
    own = (c * c).sum(1)
    for lo in range(0, len(x), RESCAN):
        part = x[lo : lo + RESCAN].astype(exact)
        d = (part * part).sum(1)[:, None] - 2 * part.dot(c.T) + own
        rows = np.arange(len(part))
        first = d.argmin(1)
        best = d[rows, first].astype("f8")
        if len(book) > 1:
            d[rows, first] = d.max() + 1
            gap[lo : lo + RESCAN] = np.sqrt(d.min(1).astype("f8")) - np.sqrt(best)
        index[lo : lo + RESCAN] = first
    return index, gap


class Heaps:
    """The heaps of one block and part position: items by entry, ascending by key."""

    def __init__(self, starts: np.ndarray, items: np.ndarray, keys: np.ndarray):
        self.starts, self.items, self.keys = starts, items, keys

    @classmethod
    def of(cls, entry: np.ndarray, item: np.ndarray, key: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((key, entry))
        return cls(np.searchsorted(entry[order], np.arange(entries + 1)), item[order], key[order])

    def entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def pop(self, reached: np.ndarray) -> np.ndarray:
        """Places of the items whose keys the drift of their entry has reached: the head of each heap."""
        heads = [np.arange(a, a + np.searchsorted(self.keys[a:b], r, "right")) for a, b, r in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), reached.tolist()) if b > a and self.keys[a] <= r]
        return np.concatenate(heads) if heads else np.zeros(0, "i8")

    def push(self, places: np.ndarray, entry: np.ndarray, key: np.ndarray) -> Heaps:
        """The heaps with the items at ``places`` under new entries and keys."""
        entries, keys = self.entry(), self.keys.copy()
        entries[places], keys[places] = entry, key
        return Heaps.of(entries, self.items, keys, len(self.starts) - 1)


@dataclass
class Change:
    """What a task's parts change in the counts and sums of one position's entries."""

    counts: np.ndarray
    sums: np.ndarray

    @classmethod
    def none(cls, shape: Shape) -> Change:
        return cls(np.zeros(shape.entries, "i8"), np.zeros((shape.limbs, shape.entries, shape.width), "i8"))

    def add(self, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
        self.counts += sign * np.bincount(entry, minlength=len(self.counts))
        limbs = [x] if len(self.sums) == 1 else [x // LIMB, x % LIMB]
        for total, limb in zip(self.sums, limbs):
            np.add.at(total, entry, sign * limb.astype("i8"))

    def packed(self) -> bytes:
        return np.concatenate([self.counts, self.sums.ravel()]).astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, shape: Shape) -> Change:
        flat = np.frombuffer(raw, "<i8")
        return cls(flat[: shape.entries].copy(), flat[shape.entries :].reshape(shape.limbs, shape.entries, shape.width).copy())


def step(x: np.ndarray, heaps: Heaps | None, book: np.ndarray, drift: np.ndarray, shape: Shape, change: Change | None) -> tuple[Heaps, int]:
    """One position of a block after a round's assignment, and how many parts it compared with all entries."""
    if heaps is None:
        places, items, old = None, np.arange(len(x)), None
    else:
        places = heaps.pop(drift + shape.margin)
        if not places.size:
            return heaps, 0
        items, old = heaps.items[places], heaps.entry()[places]
    entry, gap = nearest(x[items], book, shape.exact)
    key = gap + drift[entry]
    if change is not None:
        moved = slice(None) if old is None else entry != old
        change.add(entry[moved], x[items[moved]], 1)
        if old is not None:
            change.add(old[moved], x[items[moved]], -1)
    return (Heaps.of(entry, items, key, shape.entries) if heaps is None else heaps.push(places, entry, key)), len(items)


def cut(raw: bytes, shape: Shape) -> np.ndarray:
    """(parts, rows, width) integers of a block."""
    return np.frombuffer(raw, shape.stored).astype("i8").reshape(-1, shape.parts, shape.width).transpose(1, 0, 2)


def saved(heaps: list[Heaps]) -> bytes:
    return b"".join([*(h.starts.astype("<i8").tobytes() for h in heaps), *(h.items.astype("<i4").tobytes() for h in heaps), *(h.keys.astype("<f8").tobytes() for h in heaps)])


def loaded(raw: bytes | None, rows: int, shape: Shape) -> list[Heaps | None]:
    if raw is None:
        return [None] * shape.parts
    a = shape.parts * (shape.entries + 1) * 8
    b = a + shape.parts * rows * 4
    starts = np.frombuffer(raw[:a], "<i8").reshape(shape.parts, -1)
    items = np.frombuffer(raw[a:b], "<i4").reshape(shape.parts, -1)
    keys = np.frombuffer(raw[b:], "<f8").reshape(shape.parts, -1)
    return [Heaps(*h) for h in zip(starts, items, keys)]


def usable(vector: str) -> F.Column:
    e = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def blocks(kept: DataFrame, shape: Shape, scale: int) -> DataFrame:
    """(ids, labels, x, heaps) with up to ``BLOCK_BYTES`` of vectors a row, of rows (id, label, e)."""
    kinds = dict(kept.dtypes)
    width = shape.parts * shape.width
    rows = max(1, BLOCK_BYTES // (width * int(shape.stored[2])))

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def out():
            ids, labels = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in (0, 1))
            listed = [pa.ListArray.from_arrays([0, len(ids)], c) for c in (ids, labels)]
            x = np.concatenate([h[2] for h in held]).astype(shape.stored).tobytes()
            return pa.RecordBatch.from_arrays([*listed, pa.array([x], "binary"), pa.array([None], "binary")], names=["ids", "labels", "x", "heaps"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, min(rows - size, batch.num_rows - lo))
                e = part.column(2)
                n = np.diff(e.offsets.to_numpy())
                x = np.zeros((len(n), width), "i8")
                x[np.arange(width) < n[:, None]] = integers(e.flatten().to_numpy(zero_copy_only=False), scale)
                held.append((part.column(0), part.column(1), x))
                size += len(n)
                lo += len(n)
                if size == rows:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return shared.map_arrow(kept, run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary, heaps binary", __name__)


def assigned(staged: DataFrame, books: list[np.ndarray], drift: np.ndarray, shape: Shape) -> DataFrame:
    """The blocks with their heaps after one assignment, beside ``ARRAYS`` rows with each task's changes, and the parts compared."""
    kinds = dict(staged.dtypes)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, changes = TaskContext.get().partitionId(), [Change.none(shape) for _ in books]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = cut(one.column(2)[0].as_py(), shape)
                heaps = loaded(one.column(3)[0].as_py(), x.shape[1], shape)
                done = [step(x[p], heaps[p], books[p], drift[p], shape, changes[p]) for p in range(shape.parts)]
                yield pa.RecordBatch.from_arrays(
                    [*one.columns[:3], pa.array([saved([h for h, _ in done])], "binary"), pa.array([sum(n for _, n in done)], "int64"), pa.nulls(1, "int64"), pa.nulls(1, "int32"), pa.nulls(1, "binary")],
                    names=["ids", "labels", "x", "heaps", "compared", "at", "part", "counts"],
                )
        lists = [pa.nulls(1, f.type) for f in staged_fields]
        for p, change in enumerate(changes):
            if change.counts.any() or change.sums.any():
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.nulls(1, "binary"), pa.nulls(1, "binary"), pa.nulls(1, "int64"), pa.array([p], "int64"), pa.array([task], "int32"), pa.array([change.packed()], "binary")],
                    names=["ids", "labels", "x", "heaps", "compared", "at", "part", "counts"],
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    staged_fields = list(to_arrow_schema(staged.select("ids", "labels").schema))
    return shared.map_arrow(staged.select("ids", "labels", "x", "heaps"), run, f"ids {kinds['ids']}, labels {kinds['labels']}, x binary, heaps binary, compared long, {ARRAYS}", __name__)


def coded(staged: DataFrame, books: list[np.ndarray], drift: np.ndarray, shape: Shape, kinds: dict[str, str]) -> DataFrame:
    """(id, label, code, error) after the last assignment."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = cut(one.column(2)[0].as_py(), shape)
                heaps = loaded(one.column(3)[0].as_py(), x.shape[1], shape)
                code, error = np.zeros((x.shape[1], shape.parts), "u1"), 0
                for p, book in enumerate(books):
                    after, _ = step(x[p], heaps[p], book, drift[p], shape, None)
                    code[after.items, p] = after.entry()
                    off = x[p].astype("O" if shape.exact == "O" else "i8") - book[code[:, p]]
                    error = error + (off * off).sum(1)
                if shape.exact == "O":
                    error = np.array([min(v, LARGEST) for v in error], "i8")
                texts = [row.tobytes().hex() for row in code]
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), pa.array(texts), pa.array(error.astype("i8"))], names=["id", "label", "code", "error"])

    return shared.map_arrow(staged.select("ids", "labels", "x", "heaps"), run, f"id {kinds['id']}, label {kinds['label']}, code string, error long", __name__)


def moved(book: np.ndarray, total: Change) -> np.ndarray:
    """Entries at the floored mean of their parts; unused ones stay."""
    sums = total.sums[0] if len(total.sums) == 1 else total.sums[0].astype("O") * LIMB + total.sums[1]
    used = total.counts > 0
    out = book.copy()
    out[used] = sums[used] // total.counts[used, None]
    return out


def lengths(difference: np.ndarray) -> np.ndarray:
    return np.sqrt((difference.astype("f8") ** 2).sum(1))


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Staged (id, label, code, error) rows, the final codebooks, and how many parts each round compared with all entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code holds one byte a part: 1 to 256 entries")
    kept = vectors.where(usable(vector)).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e"))
    kinds = dict(kept.dtypes)
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("w"), F.max(F.array_max(F.transform("e", F.abs))).alias("most")).first()
    if not size.n:
        return kept.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long"), [], []
    first = kept.orderBy(F.col("id").asc_nulls_last(), "e").limit(entries).select("e").collect()
    shape = Shape(-(-size.w // parts), parts, len(first), int(min(float(size.most) * scale, CLAMP)) + 1, size.n)
    x = np.zeros((len(first), parts * shape.width), "i8")
    for i, r in enumerate(first):
        x[i, : len(r.e)] = integers(np.array(r.e), scale)
    books = list(x.reshape(-1, parts, shape.width).transpose(1, 0, 2))
    drift, totals, compared = np.zeros((parts, shape.entries)), [Change.none(shape) for _ in books], []
    staged = shared.stage(blocks(kept, shape, scale), "blocks")
    for _ in range(rounds):
        after = shared.stage(assigned(staged, books, drift, shape), "blocks")
        for r in tree_sum(after.where("counts IS NOT NULL").select("at", "part", "counts")).collect():  # one row a position
            change = Change.unpacked(bytes(r.counts), shape)
            totals[r.at].counts += change.counts
            totals[r.at].sums += change.sums
        compared.append(after.agg(F.sum("compared")).first()[0])
        shared.drop_stage(staged)
        staged = after.where("ids IS NOT NULL")
        staged._staged_path = after._staged_path
        for p, book in enumerate(books):
            books[p] = moved(book, totals[p])
            step_ = lengths(books[p] - book)
            order = np.sort(step_)
            others = np.where(step_ == order[-1], order[-2] if len(order) > 1 and (step_ == order[-1]).sum() == 1 else order[-1], order[-1])
            drift[p] = drift[p] + step_ + (others if len(order) > 1 else 0)
    out = shared.stage(coded(staged, books, drift, shape, kinds), "codes")
    shared.drop_stage(staged)
    return out, books, compared


def signature(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books, _ = compress(shared.table(spark, sf_dir, "embeddings"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    if books:  # an empty result is no staged table
        sums = shared.stage(sums, "label-errors")
    return rows.join(sums, F.expr("label <=> _label")).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(signature(books)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    square = "CAST(list_dot_product({a}, {b}) AS BIGINT)"
    steps = [f"""
kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        d = f"{square.format(a='x', b='x')} - 2 * {square.format(a='x', b='c')} + {square.format(a='c', b='c')}"
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min((d, e)) AS best
  FROM (SELECT vec_id, parts.p, label, x, e, {d} AS d FROM parts JOIN c{r} ON c{r}.p = parts.p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (
  SELECT p, e, i, sum(CAST(x[i] AS BIGINT))::BIGINT AS s, count(*) AS n
  FROM (SELECT p, best[2] AS e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.p = c{r}.p AND m{r}.e = c{r}.e)""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
   FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM c{ROUNDS})) AS codebooks_sha256
FROM coded
"""


OP12_SQL = _oracle()
