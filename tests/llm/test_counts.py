import public_tokenizers
import pytest
from hudlake.llm import counts, queries, shared, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "Plain words, and plain words again."), (2, None), (3, ""), (4, "Plain words, and plain words again."), (4, "Plain words, and plain words again."),
    (None, "no id <|endoftext|> inside <|ENDOFTEXT|>"), (6, "x" * 40_000), (7, "Ünïcode – 日本語 　 \x00 end"), (8, "many  spaces\n\n here "), (9, "MANY spaces here"),
    (10, "<|endoftext|>"), (11, "<|ENDOFTEXT|>"), (12, "word " * 3000),
]


def plain(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        return lambda t: len(p.encode(t))
    t = Tokenizer.from_file(path)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def files(cache):
    import pathlib

    return sorted(map(str, pathlib.Path(cache.removeprefix("file://")).glob("version=*/batch=*/*.parquet")))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("few", [0, counts.FEW])
def test_counts_are_the_librarys_and_misses_are_encoded_once(spark, monkeypatch, name, few):
    monkeypatch.setattr(counts, "FEW", few)
    count, cache = plain(name), shared.new_path(spark, "cache")
    docs = spark.createDataFrame([(k, t, "v", 1) for k, t in TEXTS], "doc_id long, text string, _metadata string, digest int")
    path = public_tokenizers.path(name)
    want = sorted(((k, len((t or "").encode()), n := count(t or ""), n > 1024) for k, t in TEXTS), key=repr)
    got = [tuple(r) for r in counts.count_tokens(docs, cache, vocabulary=path).drop("digest").collect()]
    assert sorted(got, key=repr) == want
    stored = counts.stored(spark, cache)
    distinct = {counts.Tokenizer(path).digest(t) for _, t in TEXTS}
    assert stored.count() == len(distinct) == spark.read.parquet(cache).count()
    # a second table: only what is new is encoded, and nothing where nothing is
    before = files(cache)
    again = docs.union(spark.createDataFrame([(20, "brand new", "v", 1), (21, "brand new", "v", 1)], docs.schema))
    assert sorted((tuple(r) for r in counts.count_tokens(again, cache, vocabulary=path).drop("digest").collect()), key=repr) == sorted(
        want + [(k, 9, count("brand new"), False) for k in (20, 21)], key=repr)
    added = spark.read.parquet(*[f for f in files(cache) if f not in before])
    assert added.count() == 1
    held = files(cache)
    counts.count_tokens(again, cache, vocabulary=path).count()
    assert files(cache) == held


def test_stored_counts_are_used_by_version(spark):
    """Counts come from the cache, for the version that stored them alone."""
    cache, docs = shared.new_path(spark, "cache"), spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    path = tokens.default_vocabulary()
    version = counts.tokenizer_version(path)
    planted = docs.where("doc_id = 1").select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    planted.write.parquet(f"{cache}/version={version}/batch=a")
    planted.select("digest", F.lit(99).cast("long").alias("n_tokens")).write.parquet(f"{cache}/version=other/batch=a")
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, cache).collect()}
    assert got == {1: 77, 2: 1}
    assert counts.tokenizer_version(public_tokenizers.path("word_bpe_49k.json")) != version


def test_texts_that_a_normaliser_cannot_tell_apart_share_a_count(spark):
    cache = shared.new_path(spark, "cache")
    docs = spark.createDataFrame([(1, "Some  words"), (2, "some words"), (3, "<|STARTOFTEXT|>"), (4, "<|startoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, cache, vocabulary=public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert spark.read.parquet(cache).count() == 3 and got[1] == got[2] and got[4] == 1 and got[3] > 1


def test_collided_places_and_empty_table(spark):
    path = tokens.default_vocabulary()
    digest = counts.Tokenizer(path).digest
    both = spark.createDataFrame([("right", digest("right")), ("wrong one", digest("right"))], "t string, digest binary")
    assert [r.n_tokens for r in counts.encoded(both, path).collect()] == [1]
    cache = shared.new_path(spark, "cache")
    assert counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), cache).collect() == [] and not files(cache)


def test_hot_copies_move_once_a_task(spark):
    """A third of all rows are copies: the aggregation by digest combines them before its exchange."""
    docs = spark.range(30_000, numPartitions=4).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('text ', id) END AS text")
    got = counts.count_tokens(docs, shared.new_path(spark, "cache"))
    assert got.count() == 30_000 and got.where("doc_id % 3 = 0").select("n_tokens").distinct().collect()[0][0] == 2


def test_query(spark):
    import pandas as pd

    count = plain("byte_bpe_50k.json")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op11_token_counts"](spark, SF).toPandas().sort_values("doc_id")
    want = [(k, len((t or "").encode()), n := count(t or ""), n > 1024) for k, t in zip(docs.doc_id, docs.text)]
    assert list(got.itertuples(index=False, name=None)) == sorted(want)
