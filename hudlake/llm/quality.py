"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

One Python pass over the texts makes the rule statistics; they are staged as a small table. Rules are
ratios of them (``RULES``). Each rule's usual range is what all but a thousandth of the good labelled
rows show (``RANGE``, over *all* labelled rows), and a row is described by how far it leaves each
range. An isolation forest isolates rows by random splits of these excesses: rows that few splits
isolate are unlike the bulk of the corpus. The forest is fitted on a bounded sample of labelled rows
(``FIT_ROWS``, the smallest hashes of their ids; trees see ``TREE_ROWS`` rows each). Its cut is
calibrated on *all* labelled rows: the share of good rows it may reject is ``GOOD_LOSS``, and the
lowest path-length score that keeps to it is the cut. The driver receives the ranges and a histogram
of scores.

Defined cases: a null text has no words and fails the base rule; so does an empty one; repeated
rows each get a row; labels of unknown ids, null labels and null ids are ignored; without labelled
rows only the base rule decides; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.llm import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 20
MOST_REPEATED = 30  # percent of words
WINDOW = 8

FIT_ROWS = 20_000
TREES, TREE_ROWS = 100, 256
GOOD_LOSS = 0.001
RANGE = 0.999
SCORE_STEPS = 2000
SEED = 11

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_digits", "n_marks", "n_distinct", "n_lines", "longest_word", "n_chars"]
STATS = ", ".join(f"{c} long" for c in BASE + EXTRA)
MARKS = re.compile(r"[!?@\\{}\[\]_~^=+]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), "i8", len(words)).view("u8") * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(n, "u8")
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + (h[k : k + n] ^ h[k : k + n] >> np.uint64(29))
    order = np.argsort(rolled, kind="stable")
    s = rolled[order]
    same = np.zeros(n, bool)
    equal = s[1:] == s[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    if not same.any():
        return 0
    seen: dict[tuple, list[int]] = {}  # the hash only nominates; windows are compared as words
    for i in np.sort(order[same]).tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    starts = np.array([i for v in seen.values() if len(v) > 1 for i in v], "i8")
    edge = np.zeros(len(words) + 1, "i8")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    count = lambda p: len(p.findall(text))
    return (
        len(words), sum(map(len, words)), count(SYMBOL), dup, repeated_words(words),
        count(UPPER), count(DIGIT), count(MARKS), len(set(words)), len(lines), max(map(len, words), default=0), len(text),
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule statistics) of every row."""

    def make():
        def work(columns):
            keys, texts = columns
            return dict(zip(["doc_id", *BASE, *EXTRA], [keys, *map(list, zip(*map(text_statistics, texts)))]))

        return work

    return shared.map_rows(docs.select(F.col(key).cast("long"), text), make, f"doc_id long, {STATS}")


W, C = "greatest(n_words, 1)", "greatest(word_chars, 1)"
RULES = {
    "word_length": f"word_chars / {W}",
    "symbol_rate": f"n_symbols / {W}",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": f"n_repeat_words / {W}",
    "upper_rate": f"n_upper / {C}",
    "digit_rate": f"n_digits / {C}",
    "mark_rate": f"n_marks / {W}",
    "variety": f"ln(greatest(n_distinct, 1)) / ln(greatest({W}, 2))",
    "line_rate": f"n_lines / {W}",
    "word_limit": "ln(1D + longest_word)",
    "space_rate": f"n_chars / {C}",
}


def excesses(rules: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far rows lie above and below the usual ranges, in widths of the range, on a log scale."""
    width = np.maximum(high - low, 1e-9)
    return np.log1p(np.concatenate([np.maximum(0, rules - high) / width, np.maximum(0, low - rules) / width], axis=1))


class Forest:
    """Isolation trees as flat arrays."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.take = min(rows, len(x))
        self.trees = [self.grow(x[rng.choice(len(x), self.take, replace=False)], rng) for _ in range(trees)]

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        depth_limit = int(np.ceil(np.log2(max(2, self.take))))
        column, cut, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            me = len(column)
            for a in (column, cut, left, right, length):
                a.append(0)
            lo, hi = part.min(0), part.max(0)
            open_columns = np.flatnonzero(hi > lo)
            if depth == depth_limit or len(part) < 2 or not len(open_columns):
                column[me], length[me] = -1, depth + unsuccessful(len(part))
                return me
            c = int(rng.choice(open_columns))
            at = min(rng.uniform(lo[c], hi[c]), np.nextafter(hi[c], lo[c]))
            goes = part[:, c] <= at
            column[me], cut[me] = c, at
            left[me], right[me] = node(part[goes], depth + 1), node(part[~goes], depth + 1)
            return me

        node(x, 0)
        return tuple(map(np.array, (column, cut, left, right, length)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for column, cut, left, right, length in self.trees:
            at = np.zeros(len(x), "i8")
            while (live := np.flatnonzero(column[at] >= 0)).size:
                node = at[live]
                at[live] = np.where(x[live, column[node]] <= cut[node], left[node], right[node])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(unsuccessful(self.take), 1e-9))


def unsuccessful(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged statistics with base_failed, anomaly (the forest's score) and kept."""
    stats = stats.withColumn("base_failed", base_failed())
    ruled = stats.select("*", *[F.expr(f"cast({x} AS double)").alias(k) for k, x in RULES.items()])
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    labelled = ruled.where(~F.col("base_failed")).join(known, "doc_id")
    ranges = labelled.where("quality = 1").agg(
        *[F.percentile_approx(k, [1 - RANGE, RANGE], 10_000).alias(k) for k in RULES]
    ).first()
    sample = shared.hash_sample(labelled, FIT_ROWS, ["doc_id", *BASE]).select(*RULES).collect()
    if not sample or ranges[0] is None:
        return stats.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    low, high = np.array([list(r) for r in ranges]).T
    forest = Forest(excesses(np.array([list(r) for r in sample]), low, high))
    target = stats.withColumn("anomaly", F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, n = to_arrow_schema(target), len(RULES)
        for batch in batches:
            rules = np.stack([c.to_numpy() for c in batch.columns[-n:]], axis=1)
            score = forest.score(excesses(rules, low, high))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n], pa.array(score)], schema=arrow)

    step = F.ceil(F.col("anomaly") * SCORE_STEPS)
    good = labelled.where("quality = 1").select(ruled.columns)  # all labelled good rows, and no others, are scored for the cut
    histogram = shared.map_arrow(good, run, target).groupBy(step.alias("s")).count().collect()
    scored = shared.map_arrow(ruled, run, target)
    cut = calibrate({r.s: r["count"] for r in histogram}) / SCORE_STEPS
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= cut))


def calibrate(good: dict[int, int], loss: float = GOOD_LOSS) -> float:
    """Lowest score step above which at most the share ``loss`` of good rows lies."""
    left = loss * sum(good.values())
    for s in sorted(good, reverse=True):
        left -= good[s]
        if left < 0:
            return s
    return 0 if good else SCORE_STEPS


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = shared.stage(statistics(shared.table(spark, sf_dir, "documents")), "statistics")
    return judge(stats, shared.table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "anomaly")
