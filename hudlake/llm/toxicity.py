"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (over UTF-8 bytes, of each word with a space on
both sides, ASCII letters in lower case) that it contains, one feature for each of ``LEVELS`` that the n-gram's
occurrences reach: a word stem that is rare in clean texts and frequent in toxic ones is told by its number. Naive Bayes turns
presence counts in toxic and clean training texts into a log-count ratio ``r`` per feature; features
with little evidence either way are dropped; a logistic regression is trained on the features scaled
by ``r`` (Wang and Manning's NBSVM scheme). A score is the logistic of the weighted sum. Lengths, levels and limits were
chosen by cross-validation on training rows.

The classifier is fitted on a bounded sample of labelled rows: at most ``FIT_ROWS`` of either class,
those of the smallest hashes of their ids, never a held-out row. Their ids are what is broadcast. Their
feature sets are staged; presence is counted and features are chosen from the counts (one row for each
of ``2 ** BUCKET_BITS`` buckets and level at most), and only the chosen features of the sample reach the driver.
Labels decide nothing else; every whole text is scored.

Defined cases: a null text counts as empty; an empty text has no features and gets the score of the
intercept; repeated rows are scored alike; of rows that repeat a labelled id, one of the least text is
learned from; a null id is not held out; conflicting or repeated labels of an id count as examples of
their own; without examples of both classes every score is 0; a very long text is hashed alone; an
empty table gives no rows; extra columns are carried through, and one that has the name of the score
column is replaced by it (callers that need both give another name).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared

GRAMS = (4, 5, 6)
BUCKET_BITS = 18
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16])
FEATURES = len(LEVELS) << BUCKET_BITS
FIT_ROWS = 1500
HOLD_OUT = 3
LEAST_TEXTS = 4
LEAST_RATIO = 2.5
SMOOTHING = 0.5
PENALTY, ROUNDS = 1.0, 500
THRESHOLD = 0.7
#: Bytes of text whose n-grams are hashed at a time.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
LOWER[9:14] = 32


def buckets(texts: list[str | None], chunk: int = CHUNK):
    """For runs of texts: hashed n-grams, and for each text where its n-grams begin in each row of hashes.

    Yields (first text, array of (len(GRAMS), bytes) bucket numbers, byte offsets of the texts); n-grams
    that reach past a text's end get the bucket -1.
    """
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size < chunk or not parts):
            raw = b" " + (texts[at] or "").encode("utf-8", "replace") + b" "
            parts.append(raw)
            size += len(raw)
            at += 1
        ends = np.cumsum([len(p) for p in parts])
        x = LOWER[np.frombuffer(b"".join(parts), "u1")].astype("u4")
        owner_end = np.repeat(ends, [len(p) for p in parts])
        index, padded = np.arange(len(x)), np.concatenate([x, np.zeros(max(GRAMS), "u4")])
        h, rows = np.zeros(len(x), "u4"), []
        for k in range(max(GRAMS)):
            h = (h ^ padded[k : k + len(x)]) * np.uint32(0x01000193)
            if k + 1 in GRAMS:
                mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                row = (mixed >> np.uint32(32 - BUCKET_BITS)).astype("i4")
                row[index + k + 1 > owner_end] = -1
                rows.append(row)
        yield first, np.stack(rows), np.concatenate([[0], ends])


def feature_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted features of each text: bucket numbers, those of the next level ``1 << BUCKET_BITS`` further on, and so forth."""
    out = []
    for _, rows, offsets in buckets(texts):
        for a, b in zip(offsets[:-1], offsets[1:]):
            own, times = np.unique(rows[:, a:b], return_counts=True)
            own, times = own[own >= 0], times[own >= 0]
            out.append(np.concatenate([own[times >= n] + (k << BUCKET_BITS) for k, n in enumerate(LEVELS)]).astype("i4"))
    return out


@dataclass
class Model:
    weights: np.ndarray  # float32 by feature: ratio times trained weight
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        by_level = self.weights.reshape(len(LEVELS), -1)
        useful = np.flatnonzero(by_level.any(0))
        slot = np.full(by_level.shape[1] + 1, len(useful), "i4")  # the last one stands for -1 and all useless buckets
        slot[useful] = np.arange(len(useful))
        reached = np.concatenate([np.zeros((1, len(useful))), np.cumsum(by_level[:, useful].astype("f8"), axis=0)])
        for first, rows, offsets in buckets(texts):
            hit = slot[rows]
            r, c = np.nonzero(hit < len(useful))
            text = np.searchsorted(offsets, c, "right") - 1
            pair, times = np.unique(text.astype("i8") * (len(useful) + 1) + hit[r, c], return_counts=True)
            weight = reached[np.searchsorted(LEVELS, times, "right"), pair % (len(useful) + 1)]
            out[first : first + len(offsets) - 1] = np.bincount(pair // (len(useful) + 1), weights=weight, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -40, 40)))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-count ratio of each feature, from the numbers of texts that hold it; 0 where there is little evidence."""
    p, q = toxic + SMOOTHING, clean + SMOOTHING
    out = np.log(p / (n_toxic + 2 * SMOOTHING)) - np.log(q / (n_clean + 2 * SMOOTHING))
    out[(toxic + clean < LEAST_TEXTS) | (np.abs(out) < LEAST_RATIO)] = 0
    return out


NEVER = -40.0


def fit(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression on the features scaled by their ratios, by accelerated gradient steps with an L2 penalty.

    ``flat`` holds the buckets of all texts, ``sizes`` how many each text has; buckets of ratio 0 are not among them.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(len(ratio), "f4"), NEVER)
    of = np.repeat(np.arange(len(sizes)), sizes)
    names, column = np.unique(flat, return_inverse=True)
    values = ratio[names]
    x = values[column]
    y, n, m = toxic.astype("f8"), len(sizes), len(names)
    w, b = np.zeros(m), 0.0
    look, look_b, momentum = w.copy(), b, 1.0
    step = 4.0 / (np.bincount(of, weights=x * x, minlength=n).max(initial=1.0) + 1)
    for _ in range(ROUNDS):
        margin = np.bincount(of, weights=x * look[column], minlength=n) + look_b
        off = 1 / (1 + np.exp(-np.clip(margin, NEVER, -NEVER))) - y
        new = look - step * (np.bincount(column, weights=x * off[of], minlength=m) / n * 50 + PENALTY * look / n)
        new_b = look_b - step * off.mean() * 50
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, look_b = new + (momentum - 1) / grown * (new - w), new_b + (momentum - 1) / grown * (new_b - b)
        w, b, momentum = new, new_b, grown
    weights = np.zeros(len(ratio), "f4")
    weights[names] = values * w
    return Model(weights, float(b))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(shared.doc_remainder(doc_id, HOLD_OUT) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None) -> Model:
    """Fit on labelled rows of ``docs`` for which ``learn``, by default those not held out, is true."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    known = labels.where(F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").cast("long"), "toxic").distinct()
    chosen = shared.stage(shared.hash_sample(known.where("toxic = 1"), FIT_ROWS, ["doc_id"]).union(
        shared.hash_sample(known.where("toxic = 0"), FIT_ROWS, ["doc_id"])
    ), "chosen")
    ids = F.broadcast(chosen.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id", "left_semi")
    examples = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def make():
        return lambda columns: {"toxic": columns[0], "buckets": feature_sets(columns[1])}

    sets = shared.stage(shared.map_rows(examples, make, "toxic int, buckets array<int>"), "features")
    of_class = {r.toxic: r["count"] for r in sets.groupBy("toxic").count().collect()}
    ratio = np.zeros(FEATURES)
    if of_class.get(0) and of_class.get(1):
        share = lambda c, n: (F.col(c) + SMOOTHING) / (n + 2 * SMOOTHING)
        apart = F.abs(F.log(share("p", of_class[1]) / share("q", of_class[0]))) >= LEAST_RATIO - 1e-6  # ``ratios`` decides
        counts = sets.select("toxic", F.explode("buckets").alias("k")).groupBy("k").agg(
            F.sum("toxic").cast("int").alias("p"), F.sum(1 - F.col("toxic")).cast("int").alias("q")
        ).where((F.col("p") + F.col("q") >= LEAST_TEXTS) & apart).toArrow()
        k, p, q = (counts.column(c).to_numpy() for c in ("k", "p", "q"))
        ratio[k] = ratios(p, q, of_class[1], of_class[0])
    useful = ratio != 0

    def select():
        return lambda columns: {"toxic": columns[0], "buckets": [x[useful[x]] for x in (np.array(b, "i4") for b in columns[1])]}

    found = shared.map_rows(sets, select, "toxic int, buckets array<int>").toArrow()
    shared.drop_stage(chosen, sets)
    buckets_ = found.column("buckets").combine_chunks()
    return fit(buckets_.flatten().to_numpy(), buckets_.value_lengths().to_numpy(), found.column("toxic").to_numpy(), ratio)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with column ``name``, the score, from column ``text`` alone."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(name)
    target = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for part in shared.slices(batch):
                found = model.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], schema=arrow)

    return shared.map_arrow(docs, run, target)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, shared.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
