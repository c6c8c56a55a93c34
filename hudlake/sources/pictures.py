"""Pictures of any format, decoded by Spark's image source on the JVM: PNG, JPEG, GIF, BMP, TIFF.

The source reads files. Bodies that come as bytes are written to the shared folder first, under the digest of
their bytes, so that equal pictures are one file and are decoded and recognised once; what is found for a
digest is joined to the rows that hold it, and no pixels are shuffled. A file is complete when it has its name: a task that
runs again, or two tasks with equal bodies, leave the same file.

Tolerance of truncated files: the JVM fills up a JPEG that ends early; a PNG that ends early is given black rows for those
that are missing before it is decoded. What cannot be decoded has height -1; files without bytes are passed over by Spark's file sources.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake import staging
from hudlake.operators.images import usable

PNG, PNG_END = b"\x89PNG\r\n\x1a\n", b"\0\0\0\0IEND\xaeB`\x82"
#: Samples a pixel by colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First column, first row, and steps between columns and rows, of the seven passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Bytes of rows up to which a PNG that ends early is filled up.
MOST_FILLED = 1 << 28


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def mended(body: bytes) -> bytes:
    """A PNG that ends early with its missing rows filled up by zeros; every other body as it is."""
    if not body.startswith(PNG) or body.endswith(PNG_END):
        return body
    at, head, before, packed = len(PNG), None, b"", b""
    while at + 8 <= len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        data = body[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR" and len(data) == 13:
            head = struct.unpack(">IIBBBBB", data)
        if kind == b"IDAT":
            packed += data
        elif not packed and len(data) == size:
            before += chunk(kind, data)
    if head is None or not packed or head[3] not in SAMPLES:
        return body
    width, height, depth, colour, _, _, interlaced = head
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PASSES] if interlaced else [(width, height)]
    whole = sum(h * (1 + -(-w * SAMPLES[colour] * depth // 8)) for w, h in sizes if w > 0 and h > 0)
    if not 0 < whole <= MOST_FILLED:
        return body
    try:
        rows = zlib.decompressobj().decompress(packed, whole)
    except zlib.error:
        return body
    return PNG + before + chunk(b"IDAT", zlib.compress(rows.ljust(whole, b"\0"), 1)) + PNG_END


def written(bodies: DataFrame, folder: str) -> int:
    """Write rows (digest, bytes) as files of ``folder``; how many rows there were."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        seen = set()
        for batch in batches:
            for digest, body in zip(*(c.to_pylist() for c in batch.columns)):
                place = f"{root}/{digest[:2]}"
                if digest in seen or files.get_file_info(f"{place}/{digest}").type == fs.FileType.File:
                    continue
                seen.add(digest)
                files.create_dir(place, recursive=True)
                mine = f"{place}/.{uuid.uuid4().hex}"
                with files.open_output_stream(mine) as out:
                    out.write(mended(body))
                files.move(mine, f"{place}/{digest}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], "int64")})

    return bodies.select("digest", "bytes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


IMAGE = "image_id string, height int, width int, channels int, data binary"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``IMAGE`` rows of the image files below ``path``, ids being their paths; what is no image has height -1."""
    found = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return found.select(plain_path(F.col("image.origin")).alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def plain_path(origin: F.Column) -> F.Column:
    """A file's address as the binary file source writes it: nothing escaped, one slash behind a scheme without host."""
    return F.regexp_replace(F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):///", "$1:/")


def of_bodies(rows: DataFrame, bad_status: int = 400) -> tuple[DataFrame, DataFrame]:
    """Rows (image_id, status, detail, bytes) as (image_id, status, detail, picture), and the staged usable pictures.

    ``picture`` is the id of the row's picture among the second table's ``IMAGE`` rows; rows whose bytes are no
    image get ``bad_status`` in place of 200.
    """
    spark = rows.sparkSession
    digest = F.when((F.col("status") == 200) & (F.length("bytes") > 0), F.sha2("bytes", 256))
    held = staging.stage(rows.select("image_id", "status", "detail", "bytes", digest.alias("digest")), "bodies")
    folder = staging.new_path(spark, "pictures")
    some = written(held.where("digest IS NOT NULL"), folder)
    found = files(spark, folder).withColumn("image_id", F.substring_index("image_id", "/", -1)) if some else spark.createDataFrame([], IMAGE)
    pictures = staging.stage(found.where(usable()), "pixels")
    staging.drop_path(spark, folder)
    good = pictures.select(F.col("image_id").alias("picture"))
    told = held.select("image_id", "status", "detail", "digest").join(good, F.col("digest") == F.col("picture"), "left")
    bad = (F.col("status") == 200) & F.col("picture").isNull()
    return told.select(
        "image_id", F.when(bad, bad_status).otherwise(F.col("status")).alias("status"), F.when(bad, F.lit("invalid image")).otherwise(F.col("detail")).alias("detail"), "picture"
    ), pictures


def of_folder(spark: SparkSession, path: str, bad_status: int = 400) -> tuple[DataFrame, DataFrame]:
    """As ``of_bodies``, of all files below ``path``; ids are their paths. Only files that do not decode are read a second time."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = staging.stage(files(spark, path), "pixels")
    good = first.where(usable())
    broken = whole.select("path", "content").join(good.select(F.col("image_id").alias("path")), "path", "left_anti")
    rows = broken.select(F.col("path").alias("image_id"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail"), F.col("content").alias("bytes"))
    told, mended_ones = of_bodies(rows, bad_status)
    fine = good.select("image_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("detail"), F.col("image_id").alias("picture"))
    return fine.union(told), good.union(mended_ones)
