"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents longer than a sequence are cut into whole-sequence pieces, the first piece taking what is
left over; every piece is then one item of a bin-packing problem with capacity ``SEQUENCE``.

An item is its length alone, so the whole corpus is a histogram of at most ``SEQUENCE`` lengths, and
the packing is solved on the histogram: a plan is a list of *patterns* (lengths of one sequence)
with multiplicities, whose size depends on the number of lengths, not on the number of documents.

1. Reduction (Martello and Toth's dominance criteria, from the largest item down). Let ``j`` be the
   largest length left. A set with ``j`` is fixed where it dominates every other set with ``j``:
   alone, if nothing fits beside it; with the largest partner ``k`` that fits, if ``j + k`` fills the
   sequence, if no two items fit beside ``j``, or if ``k`` is at least the best pair; with the best
   pair, if it fills the sequence and its two items are as close as the items left allow.
   Equal copies are fixed together, as many at a time as the histogram holds.
2. What no criterion decides is packed by best-fit decreasing, again on counts: sequences of equal
   room are one group, and a step fills as many of a group as there are items.

Documents then take their places by rank within their length. Ranks are counted within
(length, salt), with one salt for each ``RANK_ROWS`` pieces of the length, so that a length which holds
a third of all pieces is ranked by many tasks, and there are no more groups than the pieces ask for.

Defined cases: a null text counts as empty (one piece, the end id); repeated rows are packed as
rows of their own; null ids are carried through; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hudlake.llm import shared, tokens

SEQUENCE = 2048
#: Pieces of one length that one task ranks.
RANK_ROWS = 1_000


class Stock:
    """Counts of items by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.sizes = sorted(self.n)

    def take(self, size: int, many: int) -> None:
        self.n[size] -= many
        if not self.n[size]:
            del self.n[size]
            self.sizes.remove(size)

    def largest(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """Largest size of at most ``room`` when the items in ``without`` are taken."""
        at = bisect.bisect_right(self.sizes, room) - 1
        while at >= 0 and self.n[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, many: int, without: int) -> list[int]:
        """The ``many`` smallest items when one item ``without`` is taken, or fewer."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(many - len(out), self.n[s] - (s == without))
            if len(out) == many:
                break
        return out

    def best_pair(self, room: int, j: int) -> tuple[int, int] | None:
        """Two items of the largest sum within ``room`` beside ``j``; of equal sums the closest two."""
        found = [
            (a + b, a, b)
            for b in self.sizes
            if self.n[b] > (b == j) and (a := self.largest(room - b, (j, b))) is not None and a <= b
        ]
        return max(found)[1:] if found else None


def dominating(stock: Stock, capacity: int) -> tuple[tuple[int, ...], bool]:
    """A set with the largest item, and whether it dominates all others with that item."""
    j = stock.sizes[-1]
    room = capacity - j
    k = stock.largest(room, (j,))
    if k is None:
        return (j,), True
    least = stock.smallest(2, j)
    if k == room or len(least) < 2 or sum(least) > room:
        return (j, k), True
    three = stock.smallest(3, j)
    if len(three) == 3 and sum(three) <= room:
        return (j,), False  # sets of four items fit: no criterion compares them
    pair = stock.best_pair(room, j)
    if pair is None or k >= sum(pair):
        return (j, k), True
    a, b = pair
    between = [s for s in stock.sizes if a < s < b for _ in range(min(2, stock.n[s] - (s == j)))][:2]
    if a + b == room and k <= b and (len(between) < 2 or sum(between) > room):
        return (j, b, a), True
    return (j,), False


def reduce_exactly(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that an optimal packing may hold, with multiplicities, and the items left undecided.

    The criteria go from the largest item down to the first without a dominating set; below it, pairs
    that fill a sequence exactly are still fixed, for such a pair dominates whatever else is left.
    """
    stock, fixed = Stock(counts), []
    while stock.sizes:
        chosen, sure = dominating(stock, capacity)
        if not sure:
            break
        many = min(stock.n[s] // chosen.count(s) for s in set(chosen))
        fixed.append((chosen, many))
        for s in chosen:
            stock.take(s, many)
    for j in list(reversed(stock.sizes)):  # full pairs below the largest item
        k = capacity - j
        if k in stock.n and j in stock.n and (many := stock.n[j] // 2 if j == k else min(stock.n[j], stock.n[k])):
            fixed.append(((j, k), many))
            stock.take(j, many)
            stock.take(k, many)
    return fixed, dict(stock.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: patterns with multiplicities."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], many: int) -> None:
        if room not in by_room:
            bisect.insort(rooms, room)
        by_room[room].append((pattern, many))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # open new sequences
                room, pattern, many = capacity, (), left
            else:
                room = rooms[at]
                pattern, many = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            each = room // size  # the fullest sequence that takes an item takes the next one too
            whole = min(many, left // each)
            if whole:
                put(room - each * size, pattern + (size,) * each, whole)
                left -= whole * each
            over = many - whole
            if over and left:
                put(room - left * size, pattern + (size,) * left, 1)
                left, over = 0, over - 1
            if over and pattern:
                put(room, pattern, over)
    return [x for group in by_room.values() for x in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2 bound on the number of sequences."""
    best = 0
    for alpha in {0, *(s for s in counts if 2 * s <= capacity)}:
        big = sum(n for s, n in counts.items() if s > capacity - alpha)
        middle = [(s, n) for s, n in counts.items() if capacity - alpha >= s > capacity / 2]
        small = sum(s * n for s, n in counts.items() if alpha <= s <= capacity / 2)
        n_middle = sum(n for _, n in middle)
        room = n_middle * capacity - sum(s * n for s, n in middle)
        best = max(best, big + n_middle + max(0, -(-(small - room) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_exactly(counts, capacity)
    return fixed + best_fit(rest, capacity)


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset); an item of rank r is in the last row whose
    first rank is at most r, in sequence ``first sequence + r - first rank``."""
    out: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, many in patterns:
        offset = 0
        for size in pattern:
            out[size].append((rank[size], base, offset))
            rank[size] += many
            offset += size
        base += many
    return {k: np.array(v, "i8") for k, v in out.items()}


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document's token ids with the end id."""

    def make():
        encode, end = tokens.encoder(vocabulary), np.array([tokens.END_ID], "<u4").tobytes()

        def work(columns):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for k, t in zip(*columns):
                ids = encode(t) + end
                n = len(ids) // 4
                first = n % sequence or min(n, sequence)
                cuts = [0, *range(first, n + 1, sequence)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in zip(out, (k, p, a, b - a, ids[4 * a : 4 * b])):
                        out[name].append(v)
            return out

        return work

    return shared.map_rows(docs.select(F.col(key).cast("long"), text), make, PIECES, owner=tokens.__name__)


def pack(items: DataFrame, sequence: int = SEQUENCE, size: str = "length") -> DataFrame:
    """``items`` (a table that can be read twice alike) with sequence_id and offset.

    Only the histogram of lengths comes to the driver, at most ``sequence`` rows.
    """
    spark = items.sparkSession
    names = {n: shared.free_name(items.columns, n) for n in ("_salt", "_n", "_rank", "_shift", "_salts", "_place")}
    salt, n, rank_, shift_, salts, place_ = names.values()
    others = [c for c in items.columns if c != size]
    counts = {r[0]: r[1] for r in items.groupBy(size).count().collect()}
    table = spark.createDataFrame([(k, -(-v // RANK_ROWS)) for k, v in counts.items()], f"`{size}` long, `{salts}` int")
    placed = shared.with_place(items, place_)
    salted = placed.join(F.broadcast(table), size).select(*items.columns, F.pmod(F.col(place_), F.col(salts)).cast("int").alias(salt))
    by_salt = salted.groupBy(size, salt).agg(F.count("*").alias(n))
    places = runs(plan(counts, sequence))
    earlier = Window.partitionBy(size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shift = by_salt.select(size, salt, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(shift_))
    rank = F.row_number().over(Window.partitionBy(size, salt).orderBy(*others)) - 1
    ranked = salted.withColumn(rank_, rank).join(shift, [size, salt]).select(
        *items.columns, (F.col(rank_) + F.col(shift_)).cast("long").alias(rank_)
    )
    target = ranked.drop(rank_).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    at = items.columns.index(size)

    def place(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (at, batch.num_columns - 1))
            seq, off = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length):
                mine, table = np.flatnonzero(length == n), places[int(n)]
                row = np.searchsorted(table[:, 0], rank[mine], "right") - 1
                seq[mine] = table[row, 1] + rank[mine] - table[row, 0]
                off[mine] = table[row, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], schema=arrow)

    return shared.map_arrow(ranked, place, target)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence in order; a group holds ``SEQUENCE`` ids at most."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, X'', (acc, x) -> concat(acc, x.ids))").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = shared.stage(pieces(shared.table(spark, sf_dir, "documents")), "pieces")
    return pack(staged.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
