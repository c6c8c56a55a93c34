"""Language-model scores: subword lattice likelihood, beside a word-unigram base.

``score`` is the log10 of a text's probability, its end included, under a unigram model over the
vocabulary's pieces, summed over all segmentations by a forward recursion in log space (see
``lattice``). Its weights are those of the existing vocabulary, or what ``learn`` makes of the training rows by
expectation maximisation: the distinct segments of all rows are counted; those of the highest counts, at least ``WHOLE_LEAST``,
become pieces of their own, at most ``HOT_WORDS`` of them; on all others the pieces' expected counts are added up by a forward
and a backward pass, in tasks by segment and then by piece. The vocabulary's own weights start the rounds.

``base_score`` is an additive-smoothed word unigram over the counts of the training rows. Counts are
added up inside each task, then shuffled by word. The words of the highest counts, at most
``HOT_WORDS`` of at most ``LONGEST_HOT`` bytes each, go to every worker; this is the only broadcast,
and its size is bounded by these two numbers. All other tokens are the thin tail: each row's tail
words are counted per row and joined to the counts by word, so every token gets its exact count.

Defined cases: a null text counts as empty (one token, the end); repeated rows are learned from and
scored each; a null id is a training row; with no training rows every count is 0 and the vocabulary's own weights stay; an empty table
gives no rows; extra columns are ignored; a very long text is scored in parts.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import lattice, shared

HOLD_OUT = 10
SMOOTHING = 0.1
HOT_WORDS = 100_000
LONGEST_HOT = 64
#: Distinct words that a task counts before it passes the counts on.
TASK_WORDS = 200_000
#: Count from which a segment may become a piece; rarer ones teach how unseen ones are spelled.
WHOLE_LEAST = 3
#: Rounds of expectation maximisation.
ROUNDS = 1


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(shared.doc_remainder(doc_id, HOLD_OUT) == 0, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; bytes.split() splits at space and 09-0D, no more."""
    return (text or "").encode("utf-8", "replace").lower().split()


def segments(text: str | None) -> list[bytes]:
    return [s.encode("utf-8", "replace") for s in lattice.segments(text)]


def word_counts(docs: DataFrame, text: str = "text", cut: Callable[[str | None], list[bytes]] = tokens) -> DataFrame:
    """(word binary, c long) over all rows of ``docs``; the end of a text is counted as the null word."""

    def run(batches):
        import pyarrow as pa

        seen, texts = Counter(), 0

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), "binary"), "n": pa.array(list(seen.values()), "int64")})

        for batch in batches:
            for piece in shared.slices(batch):
                part = piece.column(0).to_pylist()
                texts += len(part)
                for t in part:
                    seen.update(cut(t))
                if len(seen) > TASK_WORDS:
                    yield out()
                    seen = Counter()
        if texts:
            seen[None] = texts
        yield out()

    return shared.map_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def words_of_segments(counted: DataFrame) -> DataFrame:
    """``word_counts`` by words of what it counts by segments, without another pass over texts: no word crosses segments."""

    def run(batches):
        import pyarrow as pa

        seen = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), "binary"), "n": pa.array(list(seen.values()), "int64")})

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in [None] if s is None else s.lower().split():
                    seen[w] += c
            if len(seen) > TASK_WORDS:
                yield out()
                seen = Counter()
        yield out()

    return shared.map_arrow(counted, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def hot(counts: DataFrame, most: int = HOT_WORDS, least_count: int = 1) -> F.Column:
    """Whether a word is one of the most frequent: all of the count classes that fit ``most`` words together."""
    may = F.expr(f"word IS NOT NULL AND length(word) <= {LONGEST_HOT} AND c >= {least_count}")
    short = counts.where(may).select(F.floor(8 * F.log2("c")).alias("class"))
    found, least = 0, None
    for r in sorted(short.groupBy("class").count().collect(), reverse=True):
        found += r["count"]
        if found > most:
            break
        least = r["class"]
    return F.lit(False) if least is None else may & (F.floor(8 * F.log2("c")) >= least)


def hot_words(counts: DataFrame, most: int = HOT_WORDS, least_count: int = 1) -> dict[bytes, int]:
    return {bytes(r.word): r.c for r in counts.where(hot(counts, most, least_count)).select("word", "c").collect()}


def count_segments(training: DataFrame, text: str = "text") -> DataFrame:
    """How often each segment occurs in all rows of ``training``, as a staged table for ``learn`` and ``score``."""
    return shared.stage(word_counts(training, text, segments), "segments")


def learn(counts: DataFrame, vocabulary: str | None = None, most: int = HOT_WORDS, rounds: int = ROUNDS) -> lattice.Weights | None:
    """Weights of pieces and frequent segments, learned from all rows whose segments were counted; none without rows."""
    ends = counts.where("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first().c
    if not ends:
        return None
    whole = {w.decode("utf-8"): c for w, c in hot_words(counts, most, WHOLE_LEAST).items()}
    rare = counts.where("word IS NOT NULL").where(~hot(counts, most, WHOLE_LEAST)).select("word", "c")
    weights, v = None, lattice.Vocabulary(vocabulary)
    ids = np.array([i for i, _ in v.pieces.values()])
    for _ in range(rounds):
        found = {r.piece: r.n for r in expected(rare, vocabulary, weights).groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        count, byte = np.zeros(v.size), found.pop(-1, 0.0) / 256 + SMOOTHING
        count[ids] = SMOOTHING
        count[list(found)] += list(found.values())
        total = count.sum() + 256 * byte + ends + sum(whole.values())
        with np.errstate(divide="ignore"):
            logs = np.log(count / total)
        weights = lattice.Weights(uuid.uuid4().hex, logs, math.log(byte / total), math.log(ends / total), {s: math.log(c / total) for s, c in whole.items()})
    return weights


def expected(counts: DataFrame, vocabulary: str | None, weights: lattice.Weights | None) -> DataFrame:
    """(piece, n): how often each task's segments (word, c) are expected to use a piece; byte pieces are -1 together."""
    plain = weights and lattice.Weights(weights.name, weights.pieces, weights.byte, weights.end, {})

    def run(batches):
        import pyarrow as pa

        v = lattice.vocabulary(vocabulary)
        v = v.weighted(plain) if plain else v
        count, spelled = np.zeros(v.size), 0.0
        for batch in batches:
            for part in shared.slices(batch, batch.num_rows):
                words = [w.decode("utf-8") for w in part.column(0).to_pylist()]
                times = part.column(1).to_numpy(zero_copy_only=False)
                for a, b in lattice.ranges(list(map(len, words))):
                    piece, n, more = lattice.Lattices(v, words[a:b]).expected(times[a:b])
                    count[piece] += n
                    spelled += more
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([*some, -1], "int32"), "n": pa.array([*count[some], spelled], "float64")})

    return shared.map_arrow(counts, run, "piece int, n double", lattice.__name__)


def score(
    docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, hot: int = HOT_WORDS,
    weights: lattice.Weights | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; without ``weights`` the vocabulary's own give ``score``.

    ``counted`` has the segments of ``training`` if they were counted before."""
    counts = shared.stage(word_counts(training, text) if counted is None else words_of_segments(counted), "counts")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    total, bottom = row.n, row.n + SMOOTHING * (row.v + 1)
    logs = {w: math.log10((c + SMOOTHING) / bottom) for w, c in hot_words(counts, hot).items()}
    end_log, end_known = math.log10((row.ends + SMOOTHING) / bottom), int(row.ends > 0)

    def make():
        from pyspark import TaskContext

        marginals, n = lattice.marginals(vocabulary, weights), TaskContext.get().partitionId() << 40

        def work(columns):
            import pyarrow as pa

            nonlocal n
            out = {c: [] for c in ("row", "doc_id", "n_tokens", "n_hot", "hot_log", "score")}
            rare, times, ends = [], [], [0]
            for k, t, lp in zip(*columns, marginals.texts(columns[1])):
                words = tokens(t)
                found = list(map(logs.get, words))
                missing = found.count(None)
                cold = Counter([w for w, f in zip(words, found) if f is None]) if missing else {}
                rare.extend(cold)
                times.extend(cold.values())
                ends.append(len(rare))
                for name, v in zip(out, (n, k, len(words) + 1, len(words) - missing + end_known, sum(filter(None, found)) + end_log, lp)):
                    out[name].append(v)
                n += 1
            fields = [pa.field("word", "binary"), pa.field("n", "int64")]
            flat = pa.StructArray.from_arrays([pa.array(rare, "binary"), pa.array(times, "int64")], fields=fields)
            return out | {"cold": pa.ListArray.from_arrays(pa.array(ends, "int32"), flat)}

        return work

    first = shared.stage(shared.map_rows(
        docs.select(F.col(key).cast("long"), text), make,
        "row long, doc_id long, n_tokens long, n_hot long, hot_log double, score double, cold array<struct<word:binary,n:long>>",
        lattice.BATCH_ROWS, lattice.__name__,
    ), "scored")
    tail = first.where("size(cold) > 0").select("row", F.explode("cold").alias("t")).select("row", "t.word", "t.n")
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(counts, "word", "left").select(
        "row", (F.col("n") * F.log10((c + F.lit(SMOOTHING)) / F.lit(bottom))).alias("x"), F.when(c > 0, F.col("n")).otherwise(0).alias("known")
    ).groupBy("row").agg(F.sum("x").alias("x"), F.sum("known").alias("known"))
    return first.drop("cold").join(tail, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("x", F.lit(0.0))).alias("base_score"), "score",
    )


def op9_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    training = docs.where(~out)
    counted = count_segments(training)
    return score(docs, training, weights=learn(counted), counted=counted).withColumn("held_out", out)
