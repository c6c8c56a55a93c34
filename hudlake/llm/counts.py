"""Token counts through a digest cache: a text is encoded once for each tokenizer version, ever.

A cache is a folder of Parquet batches ``version=<digest>/batch=<name>`` of (digest, n_tokens). ``digest`` is the
SHA-256 of a text's normal form, ``version`` that of the vocabulary file with the library and its version. The
normal form is what the tokenizer's own normaliser makes of a text, so texts that it cannot tell apart share a
count; a text that holds one of the tokenizer's special strings, which are found before normalising, stands
for itself, and where a vocabulary declares no normaliser (the byte-level one) digests are native expressions.

``count_tokens`` takes the digests of all rows, keeps one row's place for each distinct digest, joins digest
and version to the stored counts, brings the texts of the misses alone to the encoder, writes their counts
as a new batch, and joins counts to rows. The aggregation by digest combines copies before they are shuffled; texts
move by the place of their row, which is unique, so copies make no hot key; the last join is an ordinary one of
small rows, which adaptive execution splits where a digest is hot. Misses are broadcast while they are ``FEW`` at most,
else both sides are shuffled by place. A batch appears when its job commits; jobs that append the same
digest at a time store the same count twice, and readers take one.

Defined cases: a null text counts as empty (0 tokens); rows that repeat get a row each; a null id is carried; a
very long text is encoded alone, whole; an empty table gives no rows and appends nothing; extra columns are ignored,
whatever their names; two rows whose places collide are told apart by the digest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared, tokens
from hudlake.sources.tables import spread

LIMIT = 1024
#: Misses that are broadcast, of 40 bytes each: what a filled cache lacks of a table with little new in it.
FEW = 1_000
STORED = "digest binary, n_tokens long, version string, batch string"


def library(path: str) -> str:
    kind = {".json": "tokenizers", ".model": "sentencepiece"}.get(Path(path).suffix)
    if kind is None:
        raise ValueError(f"{path}: a vocabulary is a .json file of tokenizers or a .model file of sentencepiece")
    return kind


def tokenizer_version(path: str) -> str:
    """Digest of all that decides a count besides the text."""
    from importlib.metadata import version

    name = library(path)
    return hashlib.sha256(f"{name} {version(name)}\n".encode() + Path(path).read_bytes()).hexdigest()


def declares_normaliser(path: str) -> bool:
    return library(path) == "sentencepiece" or json.loads(Path(path).read_text())["normalizer"] is not None


class Tokenizer:
    """Counts and normal forms by one vocabulary, special strings in texts handled as its library does."""

    def __init__(self, path: str):
        if library(path) == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            self.count = lambda t: len(pieces.encode(t))
            self.normal = lambda t: pieces.normalize(t)
            self.special = []
            return
        made = tokens.Encoder(path)
        whole = made.tokenizer
        whole.encode_special_tokens = False
        whole.no_truncation()
        whole.no_padding()
        self.special = [a.content for a in whole.get_added_tokens_decoder().values()]
        self.normal = whole.normalizer.normalize_str if whole.normalizer else str
        plain = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
        if byte_level(path):  # the dictionary of pre-tokens, for texts without special strings
            self.count = lambda t: plain(t) if self.holds_special(t) else len(made.encode(t)) // 4
        else:
            self.count = plain

    def holds_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def digest(self, text: str | None) -> bytes:
        """Of a text's normal form; of a text with special strings, of itself with a mark that no normal form has."""
        t = text or ""
        return hashlib.sha256(b"\xff" + t.encode() if self.holds_special(t) and self.normal is not str else self.normal(t).encode()).digest()


def byte_level(path: str) -> bool:
    """Whether the vocabulary cuts by the byte-level pattern that ``tokens`` knows."""
    spec = json.loads(Path(path).read_text())
    cut = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")


def tokenizer(path: str) -> Tokenizer:
    return shared.resident(tokens.__name__, ("counts", path), lambda: Tokenizer(path))


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, place): ``place`` names a row alike in every scan."""
    return spread(shared.with_place(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))))


def digested(rows: DataFrame, path: str) -> DataFrame:
    """(k, place, digest, n_bytes) of rows (k, t, place)."""
    if not declares_normaliser(path):
        t = F.coalesce("t", F.lit(""))
        return rows.select("k", "place", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"))
    sized = rows.select("place", "t", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), "k")
    kind = dict(rows.dtypes)["k"]

    def make():
        digest = tokenizer(path).digest
        return lambda columns: {"place": columns[0], "digest": list(map(digest, columns[1])), "n_bytes": columns[2], "k": columns[3]}

    return shared.map_rows(sized, make, f"k {kind}, place long, digest binary, n_bytes long", owner=tokens.__name__)


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """(digest, version, n_tokens) of all batches of a cache, one row each; none where there is no cache yet."""
    try:
        rows = spark.read.schema(STORED).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (t, digest); a text that does not have its digest came by a collision of places and is left out."""

    def make():
        known = tokenizer(path)

        def work(columns):
            own = [(t or "", bytes(d)) for t, d in zip(*columns) if known.digest(t) == bytes(d)]
            return {"digest": [d for _, d in own], "n_tokens": [known.count(t) for t, _ in own]}

        return work

    return shared.map_rows(texts.select("t", "digest"), make, "digest binary, n_tokens long", owner=tokens.__name__)


def fill(rows: DataFrame, wanted: DataFrame, cache: str, version: str, path: str) -> DataFrame | None:
    """Encode and append what ``wanted`` (digest, place, n_tokens) has no count of; the new batch (digest, n_tokens), if any."""
    misses = wanted.where("n_tokens IS NULL").select("digest", "place")
    n = misses.count()
    if not n:
        return None
    few = F.broadcast(misses) if n <= FEW else misses.hint("shuffle_hash")
    batch = f"{cache}/version={version}/batch={uuid.uuid4().hex}"
    encoded(rows.select("t", "place").join(few, "place"), path).write.parquet(batch)
    return rows.sparkSession.read.schema("digest binary, n_tokens long").parquet(batch)


def count_tokens(docs: DataFrame, cache: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, digest) of every row of ``docs``, by the cache in the folder ``cache``."""
    path = vocabulary or tokens.default_vocabulary()
    version = tokenizer_version(path)
    rows = located(docs, key, text)
    keyed = shared.stage(digested(rows, path), "digests")
    ours = keyed.groupBy("digest").agg(F.min("place").alias("place")).withColumn("version", F.lit(version))
    known = stored(docs.sparkSession, cache).where(F.col("version") == version)
    wanted = shared.stage(ours.join(known, ["digest", "version"], "left").select("digest", "place", "n_tokens"), "wanted")
    counts = wanted.where("n_tokens IS NOT NULL").select("digest", "n_tokens")
    fresh = fill(rows, wanted, cache, version, path)
    if fresh is not None:
        counts = counts.union(fresh)
    over: Column = F.col("n_tokens") > limit
    return keyed.join(counts, "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens", over.alias("over_limit"), "digest")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents; each call fills a cache of its own, so none rests on an earlier call's work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, shared.new_path(spark, "token-counts")).drop("digest")
