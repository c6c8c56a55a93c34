"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; a stage's result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: a null or empty text is not toxic and fails the quality rules; rows that repeat both id and
text leave the near-duplicate stage as one row, the least by its other columns; a null id is an id like any
other, first in order; very long texts go through whole; ties (equal texts, equal scores) are decided by the
smallest id; without labels nothing is toxic and only the base rules judge quality; an empty table gives no
rows; extra columns go through the first four stages, whatever their names, and the last stage returns its
own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import packing, quality, shared, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, does not call toxic."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    name = shared.free_name(docs.columns, "score")
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest. Verdicts are matched by id and text."""
    keyed = docs.select(substrings.row_hash().alias("doc_id"), "text", F.col("doc_id").alias("id"))
    stats = shared.stage(quality.statistics(keyed.select("doc_id", "text")), "statistics")
    labels = shared.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    known = keyed.select("doc_id", "id").join(labels, "id").select("doc_id", "quality")
    row = shared.free_name(docs.columns, "_row")
    good = quality.judge(stats, known).where("kept").select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, substrings.row_hash()).join(good, row, "left_semi").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id (of equal ids, one row).

    Near means a Jaccard similarity of 0.8 over five-word shingles. Such pairs are some ten bits of 64 apart, so SimHashes of
    several blocks of bits give the candidates, by covering tables of each block; candidates are compared exactly.
    """
    row, whole = (shared.free_name(docs.columns, n) for n in ("_row", "_whole"))
    groups = shared.stage(substrings.near_documents(docs.select("doc_id", "text")), "near")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("f")).select(F.col("f.rid").alias(row))
    order = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = docs.withColumn(row, substrings.row_hash()).groupBy(row).agg(F.min_by(F.struct(*docs.columns), order).alias(whole))
    return one.join(first, row, "left_semi").select(f"{whole}.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages and paragraphs that repeat an earlier one; documents left without words go."""
    spans = substrings.removals(docs.select("doc_id", "text"))
    out = substrings.remove(docs, spans).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and places."""
    staged = shared.stage(packing.pieces(docs), "pieces")
    return packing.pack(staged.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
