"""A minimal perfect hash over known keys, and dense counts by slot that tasks add up in a tree.

``SlotTable`` gives n distinct keys, pairs of unsigned 64-bit numbers, the slots 0 to n - 1. Keys fall into a bit field;
those that are alone in their place take it, the others go on to a smaller field under another seed. A key's slot is
the number of places taken before its own. A key that is none of the n also ends in some slot, so the
keys themselves are stored by slot and compared: every other key gets -1.

Keys live in a Parquet folder that every task can open, in parts of ``PART_KEYS`` at most. A task builds the
table of a part when it needs it, which takes the same slots everywhere, for they depend on the set of keys alone. With
one part the table stays in the Python worker; with more, a task goes through them one after another for each gathered
run of rows, so that its memory is that of one part, whatever the number of keys.

Counts by slot leave a task as arrays of ``CHUNK`` slots, those that are all zero left out, and are summed ``FAN`` at a
time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hudlake.llm import shared
from hudlake.llm.records import open_folder

#: Keys of one table (some 100 MB with its counts), places a key in each field, and fields at most.
PART_KEYS, GAMMA, MOST_FIELDS = 1 << 22, 2.0, 300
#: Slots of one array of counts, and arrays that a task of the tree adds up.
CHUNK, FAN = 1 << 14, 32
ARRAYS = "at long, part int, counts binary"


def place(x: np.ndarray, y: np.ndarray, field: int, size: int) -> np.ndarray:
    z = x ^ (y * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((field + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) % np.uint64(size)


class SlotTable:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """``x`` and ``y``: the two halves of distinct keys."""
        x, y = np.asarray(x, "u8"), np.asarray(y, "u8")
        self.fields, taken, left = [], 0, np.arange(len(x))
        while left.size:
            if len(self.fields) == MOST_FIELDS:
                raise ValueError("keys of a minimal perfect hash must be distinct")
            size = -(-max(1, int(GAMMA * left.size)) // 64) * 64
            at = place(x[left], y[left], len(self.fields), size)
            alone = np.bincount(at.astype("i8"), minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            held = np.bitwise_count(words).astype("i8")
            self.fields.append((size, words, taken + np.cumsum(held) - held))
            taken += int(held.sum())
            left = left[~alone[at.astype("i8")]]
        self.x, self.y = np.zeros(len(x), "u8"), np.zeros(len(x), "u8")
        slot = self.unverified(x, y)
        self.x[slot], self.y[slot] = x, y

    def __len__(self) -> int:
        return len(self.x)

    def unverified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, live = np.full(len(x), -1, "i8"), np.arange(len(x))
        for k, (size, words, before) in enumerate(self.fields):
            at = place(x[live], y[live], k, size)
            word, bit = words[(at >> np.uint64(6)).astype("i8")], at & np.uint64(63)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = before[(at[hit] >> np.uint64(6)).astype("i8")] + np.bitwise_count(below)
            live = live[~hit]
            if not live.size:
                break
        return out

    def slots(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table does not hold."""
        x, y = np.asarray(x, "u8"), np.asarray(y, "u8")
        out = self.unverified(x, y)
        if len(self):
            out[(out >= 0) & ((self.x[out] != x) | (self.y[out] != y))] = -1
        return out


class Keys:
    """Keys in a folder: its parts' folders and sizes. What a task needs to look slots up."""

    def __init__(self, keys: DataFrame, name: str, part_keys: int | None = None):
        """``keys``: staged rows with longs x and y, each pair once."""
        total = keys.count()
        self.path, parts = shared.new_path(keys.sparkSession, name), max(1, -(-total // (part_keys or PART_KEYS)))
        part = F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int").alias("part")
        keys.select("x", "y", part).write.partitionBy("part").parquet(self.path)
        sizes = {r.part: r["count"] for r in keys.groupBy(part).count().collect()}  # one row a part
        self.sizes = [sizes.get(p, 0) for p in range(parts)]
        self.bases = [sum(self.sizes[:p]) for p in range(parts)]
        self.total = total

    def drop(self, like: DataFrame) -> None:
        shared.drop_path(like.sparkSession, self.path)

    def table(self, part: int) -> SlotTable:
        def load() -> SlotTable:
            from pyarrow import dataset

            if not self.sizes[part]:
                return SlotTable(np.zeros(0, "u8"), np.zeros(0, "u8"))
            files, root = open_folder(f"{self.path}/part={part}")
            found = dataset.dataset(root, filesystem=files, format="parquet").to_table(columns=["x", "y"])
            return SlotTable(*(found.column(c).to_numpy().view("u8") for c in ("x", "y")))

        return shared.resident(self.path, 0, load) if len(self.sizes) == 1 else load()

    def slots(self, x: np.ndarray, y: np.ndarray, tally: Tally | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """Slots over all parts, -1 for unknown keys; ``tally`` counts those found, each ``times`` times."""
        x, y = x.view("u8"), y.view("u8")
        out, live = np.full(len(x), -1, "i8"), np.arange(len(x))
        for p, base in enumerate(self.bases):
            found = self.table(p).slots(x[live], y[live])
            hit = found >= 0
            out[live[hit]] = base + found[hit]
            if tally is not None:
                tally.add(p, found[hit], None if times is None else times[live[hit]])
            live = live[~hit]
            if not live.size:
                break
        return out


class Tally:
    """Counts by slot of one task, a dense array for one part at a time; ``rows`` has what is complete."""

    def __init__(self, keys: Keys, task: int):
        self.keys, self.task, self.part, self.counts, self.rows = keys, task, None, None, []

    def add(self, part: int, slots: np.ndarray, times: np.ndarray | None) -> None:
        if part != self.part:
            self.flush()
            self.part, self.counts = part, np.zeros(self.keys.sizes[part], "i8")
        if times is None:
            self.counts += np.bincount(slots, minlength=len(self.counts))
        else:  # repeated slots, exactly: bincount's weights are doubles
            np.add.at(self.counts, slots, times)

    def flush(self) -> None:
        if self.part is not None:
            for lo in range(0, len(self.counts), CHUNK):
                chunk = self.counts[lo : lo + CHUNK]
                if chunk.any():
                    self.rows.append((self.keys.bases[self.part] + lo, self.task, chunk.astype("<i8").tobytes()))
            self.part = self.counts = None

    def take(self) -> Iterator[list[tuple[int, int, bytes]]]:
        rows, self.rows = self.rows, []
        for lo in range(0, len(rows), 32):
            yield rows[lo : lo + 32]


def tree_sum(arrays: DataFrame, fan: int = FAN) -> DataFrame:
    """``ARRAYS`` rows, one for each ``at``: staged rows of all tasks summed in a tree, ``fan`` arrays a group."""
    last = arrays.agg(F.max("part")).first()[0]

    def add(group):
        import pyarrow as pa

        total = sum(np.frombuffer(c.as_py(), "<i8") for c in group.column("counts"))
        return pa.table({"at": group.column("at")[:1], "part": group.column("part")[:1], "counts": pa.array([total.tobytes()], "binary")})

    parts = 1 if last is None else last + 1
    while True:
        parts = -(-parts // fan)
        arrays = arrays.select("at", F.floor(F.col("part") / fan).cast("int").alias("part"), "counts").groupBy("at", "part").applyInArrow(add, ARRAYS)
        if parts <= 1:
            return arrays


def added(arrays: DataFrame, fan: int = FAN) -> DataFrame:
    """(slot, f) with f > 0: ``tree_sum`` by slot."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = np.frombuffer(counts, "<i8")
                some = np.flatnonzero(f)
                yield pa.RecordBatch.from_pydict({"slot": at + some, "f": f[some]})

    return shared.map_arrow(tree_sum(arrays, fan).select("at", "counts"), spread, "slot long, f long", __name__)
