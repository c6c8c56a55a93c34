"""Token sequences as length-delimited binary records with masked checksums and an offset index.

A shard file holds one frame per sequence, in order::

    u64  length of the payload            (all integers little-endian)
    u32  masked CRC-32C of those 8 bytes
    ...  payload
    u32  masked CRC-32C of the payload

which is the framing of TFRecord files, so any reader of that format can walk a shard. The mask is
``rotate_right(crc, 15) + 0xA282EAD8``. The payload is ``u8 has_id, i64 id, u8 width, u32 count`` and
``count`` ids of ``width`` bytes (2 where all ids of the sequence fit, else 4). Next to each
``shard-NNNNN.rec`` stands ``shard-NNNNN.idx``: a u64 offset for each record and at last the file's
length, so that a reader can fetch any record, or visit records in any order, with one seek.

Writing sorts the table by id over all shards: a range exchange deals rows to shards, so no task
holds more than its range; equal ids are told apart by a hash of the text, and rows that repeat both by their
place in the files that they are read from, so any number of them is split over shards. There are as many shards
as the files behind the table hold ``SHARD_BYTES``, ``MOST_SHARDS`` at most (they grow then, and are streamed), and a few
for each core where that is less. A shard is
written under a name of its task attempt and renamed when complete: a task that runs again writes
the same bytes again, and a reader never sees half a file. Files go through ``pyarrow.fs``, which
opens local, HDFS, S3 and GCS addresses.

Defined cases: a null text is written like an empty one (the end id alone); rows of a null id come
first; repeated rows get a record each; an empty table gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared, tokens
from hudlake.sources.tables import spread

MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
BLOCK = 256
HEAD = struct.Struct("<BqBI")
#: Bytes of input files that make a shard, and least shards for each core.
SHARD_BYTES, CORE_SHARDS = 64 << 20, 4
#: Shards at most: 100 TB make shards of some 2 GB. What the driver and the exchange keep for each map and shard is bounded by it.
MOST_SHARDS = 50_000
#: Pre-tokens that a worker remembers (some 120 MB): it holds little else here.
MOST_WORDS = 500_000


@cache
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype="u4")
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ POLYNOMIAL, t >> 1).astype("u4")
    return t


@cache
def pair_table() -> np.ndarray:
    """What two bytes, as a little-endian number, make of a zero register."""
    t, x = byte_table(), np.arange(1 << 16, dtype="u4")
    first = t[x & 255]
    return first >> 8 ^ t[(first ^ x >> 8) & 255]


@cache
def zeros_table(n: int) -> np.ndarray:
    """Four tables that advance a CRC register over ``n`` zero bytes, one for each byte of the register."""
    t, out = byte_table(), np.arange(256, dtype="u4")[None, :] << np.array([0, 8, 16, 24], "u4")[:, None]
    for _ in range(n):
        out = out >> 8 ^ t[out & 255]
    return out


def advance(crc: np.ndarray, n: int) -> np.ndarray:
    a, b, c, d = zeros_table(n)
    return a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string.

    The register is linear over GF(2), so all strings are cut into blocks that are run side by side,
    two bytes of each at a time, and a string's blocks are then folded with the map that advances over
    one block's length.
    """
    t = pair_table()
    n = np.array([len(p) for p in parts], "i8")
    blocks = -(-n // BLOCK)
    # Blocks are filled from the right: leading zero bytes leave a zero register as it is.
    flat = np.zeros(int(blocks.sum()) * BLOCK, "u1")
    ends = np.cumsum(blocks) * BLOCK
    for p, size, end in zip(parts, n.tolist(), ends.tolist()):
        if size:
            flat[end - size : end] = np.frombuffer(p, "u1")
    columns = np.ascontiguousarray(flat.view("<u2").reshape(-1, BLOCK // 2).T)
    register = np.zeros(columns.shape[1], "u4")
    for column in columns:
        register = register >> 16 ^ t[(register ^ column) & 0xFFFF]
    out, first = np.zeros(len(parts), "u4"), ends // BLOCK - blocks
    for k in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > k)
        out[live] = advance(out[live], BLOCK) ^ register[first[live] + k]
    return out ^ preset(n) ^ np.uint32(0xFFFFFFFF)


def preset(n: np.ndarray) -> np.ndarray:
    """What a register of all ones becomes over ``n`` zero bytes, by binary powers of the zero map."""
    out, bit = np.full(len(n), 0xFFFFFFFF, "u4"), 0
    while (n >> bit).any():
        live = np.flatnonzero(n >> bit & 1)
        out[live] = power(bit)[0][out[live] & 255] ^ power(bit)[1][out[live] >> 8 & 255] ^ power(bit)[2][out[live] >> 16 & 255] ^ power(bit)[3][out[live] >> 24]
        bit += 1
    return out


@cache
def power(bit: int) -> np.ndarray:
    if bit == 0:
        return zeros_table(1)
    a = power(bit - 1)
    return a[0][a & 255] ^ a[1][a >> 8 & 255] ^ a[2][a >> 16 & 255] ^ a[3][a >> 24]


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(MASK_DELTA)).astype("u4")


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((h, a[i].tobytes(), p, b[i].tobytes())) for i, (h, p) in enumerate(zip(heads, payloads))]


def payload(doc_id: int | None, ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    narrow = len(wide) == 0 or int(wide.max()) < 1 << 16
    return HEAD.pack(doc_id is not None, doc_id or 0, 2 if narrow else 4, len(wide)) + (
        wide.astype("<u2").tobytes() if narrow else ids
    )


def parse(data: bytes) -> tuple[int | None, bytes]:
    """Id and little-endian 32-bit ids of a payload."""
    has, doc_id, width, count = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if len(body) != width * count:
        raise ValueError("a record's payload does not have the length that it states")
    return (doc_id if has else None), (body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes())


def unframe(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the frames at ``offsets`` (the last one is the end); raises where a checksum fails."""
    frames = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    heads, payloads = [f[:8] for f in frames], [f[12:-4] for f in frames]
    if any(struct.unpack("<Q", h)[0] != len(p) for h, p in zip(heads, payloads)):
        raise ValueError("a frame's length does not match the offset index")
    stated = np.array([struct.unpack("<I", f[8:12]) + struct.unpack("<I", f[-4:]) for f in frames], "u4").reshape(-1, 2)
    if (stated[:, 0] != masked(crc32c(heads))).any() or (stated[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a record's checksum does not match")
    return payloads


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = "shard int, path string, records long, tokens long, bytes long"


def shards(docs: DataFrame) -> int:
    """Number of shards for a table (k, t), from the size of the files that it is read from, or where that is unknown from its texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    return max(min(-(-size // SHARD_BYTES), MOST_SHARDS), CORE_SHARDS * docs.sparkSession.sparkContext.defaultParallelism)


def write(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode and write ``docs`` in ascending order of ``key``; returns the manifest of the shards, evaluated."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("place")]
    ordered = spread(shared.with_place(rows)).repartitionByRange(shards(rows), *order).sortWithinPartitions(*order).select("k", "t")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, end = tokens.encoder(vocabulary, MOST_WORDS), np.array([tokens.END_ID], "<u4").tobytes()
        folder, root = open_folder(uri)
        folder.create_dir(root, recursive=True)
        stem, mine = f"{root}/shard-{shard:05d}", uuid.uuid4().hex
        at, offsets, total, out = 0, [0], 0, None
        for batch in batches:
            for part in shared.slices(batch):
                keys, texts = (c.to_pylist() for c in part.columns)
                ids = [encode(t) + end for t in texts]
                frames = frame([payload(k, x) for k, x in zip(keys, ids)])
                out = out or folder.open_output_stream(f"{stem}.{mine}")
                for f, x in zip(frames, ids):
                    out.write(f)
                    at += len(f)
                    total += len(x) // 4
                    offsets.append(at)
        if out:
            out.close()
            with folder.open_output_stream(f"{stem}.{mine}.i") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            folder.move(f"{stem}.{mine}.i", f"{stem}.idx")
            folder.move(f"{stem}.{mine}", f"{stem}.rec")
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], "int32"), "path": [f"{uri}/shard-{shard:05d}"], "records": [len(offsets) - 1], "tokens": [total], "bytes": [at]}
            )

    return shared.stage(shared.map_arrow(ordered, run, MANIFEST, tokens.__name__), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(id, start, ids) of every record of the shards, read back through their offset indexes.

    ``start`` counts the ids of all records before it, over all shards. One row a shard is all that
    is gathered to place the shards one after another.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("start"), "shard")
    spread = placed.repartition(shared.bounded_partitions(manifest.sparkSession), "shard").select("path", "start")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                folder, stem = open_folder(path)
                with folder.open_input_file(f"{stem}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype("i8")
                with folder.open_input_file(f"{stem}.rec") as f:
                    for lo in range(0, len(offsets) - 1, shared.SLICE_ROWS):
                        part = offsets[lo : lo + shared.SLICE_ROWS + 1]
                        f.seek(int(part[0]))
                        found = [parse(p) for p in unframe(f.read(int(part[-1] - part[0])), part - part[0])]
                        sizes = np.array([len(x) // 4 for _, x in found], "i8")
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_pydict(
                            {"id": pa.array([k for k, _ in found], "int64"), "start": starts, "n_tokens": sizes, "ids": pa.array([x for _, x in found], "binary")}
                        )

    return shared.map_arrow(spread, run, "id long, start long, n_tokens long, ids binary")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read(write(docs, shared.new_path(spark, "records")))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
