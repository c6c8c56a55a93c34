"""SentencePiece encoding with sampled segmentations, and lossless decoding.

``encode`` draws one segmentation of each text by forward filtering and backward sampling over its
piece lattice (see ``lattice``). The random numbers depend on the row's key, the seed and the place in
the text alone, so a row gets the same ids in any run, partition or order. ``decode`` restores every
text exactly. ``round_trip`` does both in one Python pass and returns digests, without moving texts.

Defined cases: a null text counts as empty; an empty text has no ids; rows of equal keys draw from the
same numbers; a null key is a key; a very long text is taken in parts; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import lattice, shared

SEED = 7


def keyed(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(F.lit(seed), F.col(key).cast("long")).alias("s"))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, vocabulary: str | None = None) -> DataFrame:
    """(key, text, n_pieces, ids): ids are little-endian unsigned 32-bit piece ids."""

    def make():
        sampler = lattice.Sampler(lattice.vocabulary(vocabulary))

        def work(columns):
            keys, texts, seeds = columns
            ids = sampler.sample(texts, np.array(seeds, "i8"))
            return {"doc_id": keys, "text": texts, "n_pieces": [len(x) // 4 for x in ids], "ids": ids}

        return work

    return shared.map_rows(keyed(docs, key, text, seed), make, "doc_id long, text string, n_pieces long, ids binary", lattice.BATCH_ROWS, lattice.__name__)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with column decoded, from its ids."""

    names = encoded.columns
    at = names.index("ids")

    def make():
        v = lattice.vocabulary(vocabulary)
        return lambda columns: dict(zip(names, columns)) | {"decoded": [lattice.decode(v, x) for x in columns[at]]}

    fields = ", ".join(f"{n} {t}" for n, t in encoded.dtypes)
    return shared.map_rows(encoded, make, f"{fields}, decoded string", owner=lattice.__name__)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless) of texts that are encoded and decoded again."""

    def make():
        v = lattice.vocabulary(vocabulary)
        sampler = lattice.Sampler(v)

        def work(columns):
            keys, texts, seeds = columns
            ids = sampler.sample(texts, np.array(seeds, "i8"))
            back = [lattice.decode(v, x) for x in ids]
            return {
                "doc_id": keys, "n_pieces": [len(x) // 4 for x in ids], "ids_crc32": list(map(zlib.crc32, ids)),
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back], "lossless": [x == (t or "") for x, t in zip(back, texts)],
            }

        return work

    return shared.map_rows(
        keyed(docs, key, text, seed), make, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean", lattice.BATCH_ROWS, lattice.__name__
    )


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "documents"))
