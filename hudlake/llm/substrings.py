"""Substring deduplication: paragraphs by MinHash banding, and passages inside paragraphs by anchors.

*Paragraphs* are lines of at least ``LINE_WORDS`` words. A paragraph's 5-word shingles are reduced to
min-hashes; ``tune`` picks the fewest bands that find a pair of Jaccard similarity ``SIMILARITY`` with
probability ``RECALL``. All paragraphs that collide in a band are compared with each other by the exact
Jaccard similarity of their shingle sets; links make components, equal paragraphs belong to one component,
and all paragraphs of a component but its first are removals. (An edited word takes five shingles away, so
below 50 words a component holds little but equal lines and lines edited at an end.)

*Passages* of at least ``MIN_WORDS`` words that sit anywhere inside paragraphs collide with nothing as
parts of different lines, so the unit for them is a block of ``BLOCK`` words. Blocks start at anchors:
every window of ``REACH`` consecutive places contributes the place whose 5-word shingle hashes
lowest, so two copies of a passage always share an anchored block inside it. Blocks that occur again
are joined to their first occurrence; those that touch at the same distance become one run, and runs
are extended word by word, ``REACH`` words to both sides, against the first occurrence. Other holders of a
block may share more with each other than with its first occurrence: the windows of ``MIN_WORDS`` words
around a run that leave what the first occurrence shares are matched by their hashes. Runs of at least
``MIN_WORDS`` words are removals.

The first occurrence, by (doc_id, row hash, place), always stays. Words are runs of non-white-space
bytes, ASCII letters compared in lower case. Shingles, blocks and windows are told apart by 64-bit hashes of
64-bit hashes of their words; the words next to a block are compared as they are, longer ones than ``LONGEST_WORD`` bytes by
128-bit hashes. Rows move between stages as (hash, place) numbers, with the words next to blocks where these are to be compared: as
text, which is compressed on its way and hashes are not. Texts are shuffled once to look up words around
candidate places, and once more to cut removals out.

Defined cases: a null text has no words and stays null; rows that repeat both id and text count as one
document, and all of them are cut alike; null ids sort first; an empty table gives no rows; extra
columns pass through ``remove``, whatever their names, and are otherwise ignored; a very long text is
taken up alone.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hudlake.llm import shared, simhash
from hudlake.llm.embeddings import local_roots

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
MIN_WORDS, LINE_WORDS = 50, 20
BLOCK = 20
REACH = MIN_WORDS - BLOCK + 1
PAIRED, MEMBERS, COLUMNS = 16, 128, 4096
#: Words whose hashes a worker remembers before it forgets them all, and the longest of them.
MOST_CODES, LONGEST_WORD = 300_000, 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tune(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 2) -> tuple[int, int]:
    """Fewest bands of ``rows`` min-hashes each that find a pair of the similarity with probability ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 62, n, dtype="u8") * np.uint64(2) + np.uint64(1)


BANDS, ROWS = tune()
MULTIPLIERS = multipliers(BANDS * ROWS)
#: Of whole documents: recall of the candidates at ``SIMILARITY``, bits that may differ in a block, and words of a SimHash at least.
DOC_RECALL, DOC_RADIUS, DOC_PRINT = 0.999, 3, 4
#: Blocks whose tables are dealt out at a time, behind the first.
DOC_BLOCKS = 4
#: Documents of a crowd that a task compares with as many others; documents that a crowd may get beside those linked to its
#: middle, else its tables are compared one by one; and those of one table that a task looks at together.
CROWD, MOST_CROWD, TABLE_ROWS = 256, 7680, 4096


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)
    return z ^ z >> np.uint64(28)


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns of hashes, in their order."""
    out = parts[0] + np.uint64(1)
    for p in parts[1:]:
        out = out * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(1)
    return mix(out)


class Codes(dict):
    """64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_WORD:
            self[word] = code
        return code


CODES = Codes()


def in_text(words: list[bytes]) -> bytes:
    """Words next to a block as one text of words with a space between; no word holds a tab."""
    return b" ".join([w if len(w) <= LONGEST_WORD else b"\t" + xxhash.xxh3_128_hexdigest(w).encode() for w in words])


def word_codes(lines: list[list[bytes]]) -> np.ndarray:
    if len(CODES) > MOST_CODES:
        CODES.clear()
    return np.fromiter(map(CODES.__getitem__, chain.from_iterable(lines)), "u8", sum(map(len, lines)))


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the 5 words from each place on; shorter for fewer words than 5: none."""
    n = len(codes) - SHINGLE + 1
    return fold([codes[k : k + n] for k in range(SHINGLE)]) if n > 0 else np.zeros(0, "u8")


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each window of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(h: np.ndarray, places: int) -> np.ndarray:
    """Of the first ``places`` places, those with the lowest hash of some window of ``REACH`` places.

    Where a block overlaps with equal ones on both sides, as in periodic text, one in each ``REACH`` stays.
    """
    if places < 1:
        return np.zeros(0, "i8")
    whole, h = h, h[:places]
    if places <= REACH:
        at = np.flatnonzero(h == h.min())
    else:
        low = sliding(h, REACH, np.minimum)
        top = np.concatenate([np.zeros(REACH - 1, "u8"), low, np.zeros(REACH - 1, "u8")])
        at = np.flatnonzero(sliding(top, REACH, np.maximum) == h)
    value = block_hashes(whole, at)
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] - at[:-1] >= BLOCK)])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    step = (at - at[start]) // REACH
    keep = fresh | np.concatenate([fresh[1:], [True]]) | np.concatenate([[True], step[1:] != step[:-1]])
    return np.sort(at[keep])


def block_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the blocks at the places, of the shingle hashes."""
    return fold([h[at + SHINGLE * k] for k in range(BLOCK // SHINGLE)]) if len(at) else np.zeros(0, "u8")


def split(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode("utf-8", "replace").lower().split(b"\n")]


def units_of(text: str | None) -> dict[str, np.ndarray]:
    """Places and hashes of a text's blocks, and of its paragraphs with their band keys."""
    lines = split(text or "")
    codes = word_codes(lines)
    h = shingle_hashes(codes)
    at = anchors(h, len(codes) - BLOCK + 1)
    sizes = np.array([len(x) for x in lines], "i8")
    starts = np.cumsum(sizes) - sizes
    use = sizes >= LINE_WORDS
    starts, sizes = starts[use], sizes[use]
    bands = np.zeros((len(starts), BANDS), "u8")
    line_hash = np.zeros(len(starts), "u8")
    if len(starts):
        cuts = np.stack([starts, starts + sizes - SHINGLE + 1], axis=1).ravel()
        padded = np.concatenate([h, np.zeros(1, "u8")])
        low = np.minimum.reduceat(padded * MULTIPLIERS[:, None], cuts, axis=1)[:, ::2].reshape(BANDS, ROWS, -1)
        bands[:] = fold([*low.swapaxes(0, 1), np.arange(BANDS, dtype="u8")[:, None]]).T
        line_hash = sequence_hashes(codes, starts, sizes)
    return {
        "b_start": at, "b_hash": block_hashes(h, at),
        "l_start": starts, "l_len": sizes, "l_hash": line_hash, "bands": bands.ravel(),
    }


def sequence_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence of words; sequences ascend and hold a word at least."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0xD6E8FEB86659FD93, "u8"))
    terms = mix(codes[np.repeat(starts, sizes) + place] + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes))


def word_hash(codes: np.ndarray) -> int:
    """A 64-bit hash of one sequence of words, which may be empty."""
    return int(sequence_hashes(codes, np.array([0]), np.array([len(codes)]))[0]) if len(codes) else 0


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


UNITS = (
    "rid long, doc_id long, b_start array<int>, b_hash array<long>, l_start array<int>, l_len array<int>, l_hash array<long>, bands array<long>"
)


def units(docs: DataFrame) -> DataFrame:
    """One row per document: its blocks and paragraphs as parallel arrays."""

    def make():
        def work(columns):
            rid, doc_id, texts = columns
            found = [units_of(t) for t in texts]
            out = {"rid": rid, "doc_id": doc_id}
            for name in found[0] if found else ():
                kind = "i4" if name in ("b_start", "l_start", "l_len") else "i8"
                out[name] = [f[name].astype("u8").view("i8").astype(kind) for f in found]
            return out

        return work

    return shared.map_rows(docs.select(row_hash().alias("rid"), F.col("doc_id").cast("long"), "text"), make, UNITS)


def runs(staged: DataFrame) -> DataFrame:
    """(rid, doc_id, s, e, of_rid, of_doc_id, shift, crowd): runs of blocks that repeat their first occurrence.

    Words s..e of the row are words s - shift..e - shift of the other; ``crowd`` tells that a block has more holders.
    """
    blocks = staged.select("rid", "doc_id", F.explode(F.arrays_zip("b_start", "b_hash")).alias("b")).select(
        "rid", "doc_id", F.col("b.b_start").alias("start"), F.col("b.b_hash").alias("h")
    )
    first = blocks.groupBy("h").agg(F.min(F.struct("doc_id", "rid", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    # A table of its own, so that adaptive execution can split the join where one block has very many holders.
    first = shared.stage(first.select("h", (F.col("n") > 2).alias("crowd"), F.col("f.doc_id").alias("of_doc_id"), F.col("f.rid").alias("of_rid"), F.col("f.start").alias("of_start")), "first")
    again = blocks.join(first, "h").where("rid != of_rid OR start != of_start").select(
        "rid", "doc_id", "start", "of_rid", "of_doc_id", (F.col("start") - F.col("of_start")).alias("shift"), "crowd"
    ).distinct()
    found = shared.stage(touching(again.select("rid", "doc_id", F.col("start").alias("s"), (F.col("start") + BLOCK).alias("e"), "of_rid", "of_doc_id", "shift", "crowd")), "runs")
    shared.drop_stage(first)
    return found


def touching(spans: DataFrame) -> DataFrame:
    """Spans (rid, doc_id, s, e, of_rid, of_doc_id, shift, crowd) of the same copy and shift that touch or overlap, as one."""
    order = Window.partitionBy("rid", "of_rid", "shift").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    return numbered.groupBy("rid", "of_rid", "shift", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("of_doc_id").alias("of_doc_id"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("crowd").alias("crowd")
    ).select("rid", "doc_id", "s", "e", "of_rid", "of_doc_id", "shift", "crowd")


def covered(spans: DataFrame) -> DataFrame:
    """(rid, from, to): the words that spans cover, whatever they are copies of, as disjoint intervals."""
    order = Window.partitionBy("rid").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(order))
    return numbered.groupBy("rid", "part").agg(F.min("s").alias("from"), F.max("e").alias("to")).drop("part")


def paragraphs(staged: DataFrame) -> DataFrame:
    return staged.select("rid", "doc_id", F.explode(F.arrays_zip("l_start", "l_len", "l_hash")).alias("l")).select(
        "rid", "doc_id", F.col("l.l_start").alias("s"), (F.col("l.l_start") + F.col("l.l_len")).alias("e"), F.col("l.l_hash").alias("h")
    )


def crowded(keyed: DataFrame) -> DataFrame:
    """(h, k, n): members of the bands that hold n > 1 different ones, of distinct (h, k)."""
    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, "k").select("h", "k", "n")


def collisions(staged: DataFrame) -> DataFrame:
    """(h, k, n): the paragraphs that share a band with different ones."""
    rows = staged.select(F.explode(F.transform("l_hash", lambda h, i: F.struct(h.alias("h"), F.slice("bands", i * BANDS + 1, BANDS).alias("k")))).alias("l"))
    return crowded(rows.select(F.col("l.h").alias("h"), F.explode("l.k").alias("k")).distinct())


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sets, by products of 0/1 columns, ``COLUMNS`` at a time."""
    n = len(grams)
    owner = np.repeat(np.arange(n), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    wide = count > 1
    number = np.cumsum(wide) - 1
    keep = wide[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), "f4")
    for lo in range(0, int(wide.sum()), COLUMNS):
        s, e = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((n, COLUMNS), "f4")
        x[owner[s:e], column[s:e] - lo] = 1
        out += x @ x.T
    return out


def similar(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (h, other) of Jaccard similarity ``SIMILARITY``."""
    pairs = pairs.join(grams, "h").join(grams.select(F.col("h").alias("other"), F.col("grams").alias("g2")), "other")
    both = F.size(F.array_intersect("grams", "g2"))
    return pairs.where(both >= SIMILARITY * (F.size("grams") + F.size("g2") - both)).select("h", "other")


def near(met: DataFrame, grams: DataFrame) -> DataFrame:
    """Edges (h, other) that connect the members of ``crowded`` bands as the pairs of Jaccard similarity ``SIMILARITY`` do.

    All members of a band are compared with each other: as pairs in bands of up to ``PAIRED``, and in
    larger ones in blocks of ``MEMBERS``, each pair of blocks by a task that reports one edge a member,
    to the smallest member of its local component.
    """
    few = met.where(F.col("n") <= PAIRED).select("h", "k")
    found = similar(few.join(few.select(F.col("h").alias("other"), "k"), "k").where("h < other").select("h", "other").distinct(), grams)

    chunks = F.ceil(F.col("n") / F.lit(MEMBERS)).cast("int")
    many = met.where(F.col("n") > PAIRED).withColumn("chunk", F.pmod(F.xxhash64("h"), chunks).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), chunks - 1))
    ).select("h", "k", "chunk", F.least("chunk", "with").alias("a"), F.greatest("chunk", "with").alias("b"))

    return found.union(many.join(grams, "h").groupBy("k", "a", "b").applyInArrow(linked, "h long, other long")).distinct()


def linked(group):
    """One edge for each row of a group that the links of ``SIMILARITY`` between different chunks, or within the only one, connect to another."""
    import pyarrow as pa

    group = group.sort_by("h")
    h, chunk = group.column("h").to_numpy(), group.column("chunk").to_numpy()
    sets = group.column("grams").combine_chunks()
    ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    sets = [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]
    size = np.array([len(g) for g in sets])
    common = overlaps(sets)
    link = common >= SIMILARITY * (size[:, None] + size[None, :] - common)
    if chunk.min() != chunk.max():
        link &= chunk[:, None] != chunk[None, :]
    root = local_roots(len(h), *np.nonzero(np.triu(link, 1)))
    some = np.flatnonzero(root != np.arange(len(h)))
    return pa.table({"h": h[some], "other": h[root[some]]})


def unlike(similarity: float = SIMILARITY) -> float:
    """The probability that a bit of two SimHashes differs, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_apart(words: int) -> int:
    """Bits of so many words in which SimHashes of similar documents differ: their mean and six standard deviations."""
    bits = 64 * words
    return int(bits * unlike() + 6 * math.sqrt(bits * unlike() * (1 - unlike())))


def covering(n: int, similarity: float = SIMILARITY, recall: float = DOC_RECALL) -> tuple[list[int], int]:
    """Masks of the covering tables of one block of a SimHash, and the number of blocks, for so many documents.

    Bits of two documents of Jaccard similarity J differ with probability acos(2J / (1 + J)) / pi at most. A table keeps about as many
    bits as tell ``n`` documents apart, so a document meets some one that is unlike it, which ``Buckets`` drops; blocks are added until a pair of the similarity shares a
    table with probability ``recall``, by 20,000 drawn differences. A pair that differs in at most ``DOC_RADIUS`` bits of
    a block shares one for certain.
    """
    tables = 2 ** (DOC_RADIUS + 1) - 1
    bits = min(64, math.ceil(math.log2(max(n, 1 << 10)) * tables / 2**DOC_RADIUS))
    masks = simhash.masks(DOC_RADIUS, bits)
    differ = np.random.default_rng(3).random((20_000, bits)) < unlike(similarity)
    differ = (differ * (np.uint64(1) << np.arange(bits, dtype="u8"))).sum(1, dtype="u8")
    hit = ((differ[:, None] & np.array(masks, "u8")) == 0).any(1).mean()
    return masks, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def simhash_words(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of ``n`` words of 64 bits, of the distinct shingle hashes: each bit by majority of a hash of its own."""
    h = np.unique(h)
    return np.array([simhash.majority(mix(h * m).view("i8")) for m in multipliers(n)], "i8").view("u8")


def apart(a: str, b: str) -> str:
    """SQL for the number of differing bits of two arrays of longs."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"


def table_rows(prints: DataFrame, masks: list[int], blocks: tuple[int, int]) -> DataFrame:
    """(k, h, x, y, label): the documents (h, print, label) in the tables of some blocks, with the last two words of their SimHashes."""
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string("k long, h long, x long, y long, label long")

    def run(batches):
        import pyarrow as pa

        keep, (first, last) = np.array(masks, "u8"), blocks
        number = np.arange(first * len(keep), last * len(keep), dtype="u8").reshape(last - first, -1)
        for batch in batches:
            for part in shared.slices(batch, 1024):
                h, words, label = part.columns
                words = words.flatten().to_numpy().view("u8").reshape(len(h), -1)
                kept = words[:, first:last, None] & keep
                k = fold([kept, np.broadcast_to(number, kept.shape)]).view("i8").reshape(len(h), -1)
                each = [c.view("i8") for c in (h.to_numpy().view("u8"), words[:, -2], words[:, -1], label.to_numpy().view("u8"))]
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), *[pa.array(np.repeat(c, k.shape[1])) for c in each]], names=target.names)

    return shared.map_arrow(prints.select("h", "print", F.coalesce("label", F.lit(0)).alias("label")), run, target)


class Buckets:
    """Candidates out of rows (k, h, x, y, label) that ascend by k, as (h, other, k, crowd) with other or k null.

    Of tables of up to ``PAIRED`` documents: pairs that may be similar by x and y. Of larger ones: the documents that may be similar to
    another there; where some have the label of a crowd, which is odd, only those without it, with the commonest such label. Documents of
    one label are settled: linked already, or compared in one crowd.
    """

    def __init__(self):
        self.held, self.open, self.most = None, None, most_apart(2)

    def add(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Candidates of the tables that end in these rows, and of the first rows of a very large one."""
        if self.held is not None:
            rows = [np.concatenate(c) for c in zip(self.held, rows)]
        k = rows[0]
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if len(k) - last > TABLE_ROWS:  # it goes on perhaps: its rows are taken as they come
            self.held, whole = None, False
        else:
            self.held, whole = [c[last:] for c in rows], True
        out = self.candidates([c[:last] for c in rows] if whole else rows)
        if not whole:
            self.open = k[-1]
        return out

    def end(self) -> list[np.ndarray]:
        return self.candidates(self.held) if self.held is not None else [np.zeros(0, "i8")] * 4

    def candidates(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        k, h, x, y, label = rows
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, "i8")
        size = np.diff(np.concatenate([start, [len(k)]]))
        large = (size > PAIRED) | (k[start] == self.open) if self.open is not None else size > PAIRED
        out = [np.stack([np.zeros(0, "i8")] * 4)]
        left = np.repeat(np.where(large, 0, size), size) - (np.arange(len(k)) - np.repeat(start, size))
        for d in range(1, PAIRED):
            at = np.flatnonzero(left > d)
            if not len(at):
                break
            to = at + d
            new = (h[at] != h[to]) & ((label[at] != label[to]) | (label[at] == 0)) & (self.bits(x[at] ^ x[to], y[at] ^ y[to]) <= self.most)
            a, b = h[at[new]], h[to[new]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), "i8"), np.zeros(len(a), "i8")]))
        for s, n in zip(start[large], size[large]):
            out.append(self.crowd(int(k[s]), *[c[s : s + n] for c in (h, x, y, label)]))
        return list(np.concatenate(out, axis=1))

    @staticmethod
    def bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x.view("u8")).astype("i2") + np.bitwise_count(y.view("u8"))

    def crowd(self, k: int, h: np.ndarray, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
        none = np.stack([np.zeros(0, "i8")] * 4)
        whole = k != self.open and len(h) <= TABLE_ROWS
        if whole:
            some = np.concatenate([(self.bits(x[i : i + 256, None] ^ x, y[i : i + 256, None] ^ y) <= self.most).sum(1) > 1 for i in range(0, len(h), 256)])
            h, label = h[some], label[some]
            if len(h) < 2 or label[0] and (label == label[0]).all():
                return none
        names, counts = np.unique(label[label % 2 != 0], return_counts=True)
        of = 0
        if whole and len(names):
            of = names[counts.argmax()]
            h = h[label != of]
        return np.stack([h, np.zeros(len(h), "i8"), np.full(len(h), k), np.full(len(h), of)])


def candidates(keyed: DataFrame) -> DataFrame:
    """(h, other, k, crowd) as ``Buckets`` has them, of the rows of ``table_rows``; 0 stands for none."""

    def run(batches):
        import pyarrow as pa

        found = Buckets()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.add([c.to_numpy() for c in batch.columns])], names=["h", "other", "k", "crowd"])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.end()], names=["h", "other", "k", "crowd"])

    return shared.map_arrow(keyed.repartition("k").sortWithinPartitions("k"), run, "h long, other long, k long, crowd long")


def across(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Edges (h, other) of the crowds (h, crowd, old): new members are compared with all, unless there are over ``MOST_CROWD``: then with old ones."""
    crowd = Window.partitionBy("crowd")
    news, olds = F.count(F.when(~F.col("old"), 1)).over(crowd), F.count(F.when(F.col("old"), 1)).over(crowd)
    rows = rows.withColumns({"news": news, "r": F.ceil(news / F.lit(CROWD)).cast("int"), "l": F.ceil(olds / F.lit(CROWD)).cast("int")})
    rows = rows.withColumn("chunk", F.expr("cast(pmod(xxhash64(h), CASE WHEN old THEN l ELSE r END) AS int) + CASE WHEN old THEN r ELSE 0 END"))
    many = f"CASE WHEN old THEN r WHEN news > {MOST_CROWD} THEN l ELSE r + l END"  # a new member's partners: new chunks, then old ones
    first = f"CASE WHEN NOT old AND news > {MOST_CROWD} THEN r ELSE 0 END"
    dealt = rows.where(f"r > 0 AND {many} > 0").withColumn("with", F.explode(F.expr(f"sequence({first}, {first} + {many} - 1)")))
    dealt = dealt.select("h", "crowd", "chunk", F.least("chunk", "with").alias("a"), F.greatest("chunk", "with").alias("b"))
    return dealt.join(grams, "h").groupBy("crowd", "a", "b").applyInArrow(linked, "h long, other long")


def gathered(fresh: DataFrame, salt: int) -> DataFrame:
    """(h, k, crowd, middle): large tables (h, k) without a crowd, those that share documents as one crowd; its middle is in most of them."""
    spokes = fresh.withColumn("first", F.min("h").over(Window.partitionBy("k")))
    name = shared.components(spokes, "h", "first").select(F.col("node").alias("h"), F.xxhash64("component", F.lit(salt)).bitwiseOR(F.lit(1)).alias("crowd"))
    each = fresh.groupBy("h").agg(F.count("*").alias("tables")).join(name, "h")
    middle = each.groupBy("crowd").agg(F.max_by("h", F.struct("tables", "h")).alias("middle"))
    return fresh.join(each.join(middle, "crowd").select("h", "crowd", "middle"), "h")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(rid, doc_id, h, print): the hash of a text's words and its SimHash of so many words of bits, null below a shingle."""

    def make():
        def work(columns):
            rid, doc_id, texts = columns
            codes = [word_codes(split(x or "")) for x in texts]
            grams = [shingle_hashes(c) for c in codes]
            return {
                "rid": rid, "doc_id": doc_id, "h": np.array([word_hash(c) for c in codes], "u8").view("i8"),
                "print": [simhash_words(g, words).view("i8") if len(g) else None for g in grams],
            }

        return work

    return shared.map_rows(docs, make, "rid long, doc_id long, h long, print array<long>")


def gram_sets(texts: DataFrame) -> DataFrame:
    """(h, grams) of (h, text): the distinct shingle hashes."""

    def make():
        def work(columns):
            h, texts = columns
            return {"h": h, "grams": [np.unique(shingle_hashes(word_codes(split(x or "")))).view("i8") for x in texts]}

        return work

    return shared.map_rows(texts, make, "h long, grams array<long>")


def near_documents(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, component): documents whose shingle sets have Jaccard similarity ``SIMILARITY``, linked into components.

    Candidates share a covering table of a block of their SimHashes (see ``covering``) and are compared exactly. The first
    block goes ahead, the others follow some at a time. Large tables that share documents are one *crowd*, whose
    documents are compared once, whatever tables they meet in later: all with the crowd's middle, and those that
    do not link to it with all. Documents that come to a crowd's table later are compared with the whole crowd and belong to it then. A
    crowd of more than ``MOST_CROWD`` such documents is compared by tables (see ``near``). Equal sequences of words are one document; those
    of fewer words than a shingle link with nothing else.
    """
    masks, blocks = covering(docs.count())
    width = max(blocks, DOC_PRINT)
    keyed = docs.select(row_hash().alias("rid"), F.col("doc_id").cast("long"), "text")
    staged = shared.stage(signatures(keyed, width), "documents")
    prints = shared.stage(staged.where("print IS NOT NULL").groupBy("h").agg(F.min_by("print", "rid").alias("print"), F.min("rid").alias("rid")), "prints")
    edges = groups = crowds = None
    labelled = prints.withColumn("label", F.lit(None).cast("long"))
    for low, high in [(0, 1), *((b, min(b + DOC_BLOCKS, blocks)) for b in range(1, blocks, DOC_BLOCKS))]:
        met = shared.stage(candidates(table_rows(labelled, masks, (low, high))), "met")
        pairs = met.where("other != 0").select("h", "other").distinct()
        pairs = pairs.join(prints.select("h", "print"), "h").join(prints.select(F.col("h").alias("other"), F.col("print").alias("print2")), "other")
        pairs = shared.stage(pairs.where(F.expr(apart("print", "print2")) <= most_apart(width)).select("h", "other"), "pairs")
        named = pairs.select("h").union(pairs.select("other"))
        large, old, spare = met.where("other = 0").select("h", "k", "crowd"), None, []
        if not large.isEmpty():
            table = Window.partitionBy("k")  # the parts of a very large one have not been looked at together
            fresh = large.where("crowd = 0").select("h", "k").join(labelled.select("h", F.coalesce("label", "h").alias("label")), "h")
            fresh = fresh.withColumns({"a": F.min("label").over(table), "b": F.max("label").over(table)}).where("a != b").select("h", "k")
            fresh = shared.stage(gathered(fresh, low), "fresh")
            late = large.where("crowd != 0").select("h", "crowd").distinct()
            old = late.limit(0) if crowds is None else crowds.join(late.select("crowd").distinct(), "crowd").select("h", "crowd")
            late, old = shared.stage(late, "late"), shared.stage(old, "old")
            spare = [fresh, late, old]
            named = named.union(fresh.select("h")).union(late.select("h")).union(old.select("h"))
        first = prints.join(named.distinct(), "h").select("h", "rid")
        texts = keyed.select("rid", "text").join(first, "rid").select("h", "text")
        grams = shared.stage(gram_sets(texts).dropDuplicates(["h"]), "grams")
        found = similar(pairs, grams)
        if old is not None:
            members = fresh.select("h", "crowd", "middle").distinct()
            star = shared.stage(similar(members.where("h != middle").select("h", F.col("middle").alias("other")), grams), "star")
            spare.append(star)
            members = members.join(star.select("h", F.lit(True).alias("old")), "h", "left").select("h", "crowd", (F.col("old").isNotNull() | F.expr("h = middle")).alias("old"))
            dealt = members.union(late.select("h", "crowd", F.lit(False))).union(old.select("h", "crowd", F.lit(True)))
            dealt = shared.stage(dealt.groupBy("h", "crowd").agg(F.max("old").alias("old")), "dealt")
            spare.append(dealt)
            big = shared.stage(dealt.where("NOT old").groupBy("crowd").count().where(F.col("count") > MOST_CROWD).select("crowd"), "big")
            spare.append(big)
            settled, found = dealt.select("h", "crowd"), found.union(star)
            if not big.isEmpty():  # the tables themselves are compared, and late documents with those that were there
                by_table = fresh.select("h", "k", "crowd").union(large.where("crowd != 0")).join(big, "crowd").select("h", "k")
                found = found.union(near(by_table.withColumn("n", F.count("*").over(table)), grams))
                settled = settled.join(big, "crowd", "left_anti")
                dealt = dealt.join(fresh.select("crowd").distinct().join(big, "crowd"), "crowd", "left_anti")
            found = found.union(across(dealt, grams))
            # A document has one crowd, the first that it came to.
            fresh_names = settled.groupBy("h").agg(F.min("crowd").alias("crowd"))
            crowds = shared.stage(fresh_names if crowds is None else crowds.union(fresh_names.join(crowds, "h", "left_anti")), "crowds")
        # A component is a star around its smallest member: the edges of earlier blocks are no longer needed.
        edges = found if edges is None else edges.union(found)
        groups = shared.stage(shared.components(edges, "h", "other"), "groups").withColumnRenamed("node", "h")
        edges = groups.select("h", F.col("component").alias("other"))
        labelled = prints.join(groups.select("h", F.col("component").bitwiseAND(F.lit(-2)).alias("label")), "h", "left")
        if crowds is not None:
            labelled = labelled.join(crowds, "h", "left").withColumn("label", F.coalesce("crowd", "label"))
        shared.drop_stage(met, pairs, grams, *spare)
    return staged.select("rid", "doc_id", "h").join(groups, "h", "left").select("rid", "doc_id", F.coalesce("component", "h").alias("component"))


def windows(s: int, e: int, words: int) -> np.ndarray:
    """Starts of the windows of ``MIN_WORDS`` words, in a text of so many, that hold a block of s..e and words outside."""
    w = np.arange(max(0, s + BLOCK - MIN_WORDS), min(e - BLOCK, words - MIN_WORDS) + 1)
    return w[(w < s) | (w + MIN_WORDS > e)]


def window_hashes(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (fold([h[w + SHINGLE * k] for k in range(MIN_WORDS // SHINGLE)]) if len(w) else np.zeros(0, "u8")).view("i8")


def elsewhere(found: DataFrame, around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows beside runs that repeat in other places than the run's first occurrence, as spans; and a staged table behind them.

    ``found`` has the windows of each run that leave what its first occurrence shares; they are compared, by
    hash, with each other and with the windows beside first occurrences.
    """
    opened = F.explode(F.arrays_zip("w", "w_hash")).alias("x")
    ours = found.select("rid", "doc_id", opened).select("rid", "doc_id", F.col("x.w").alias("s"), F.col("x.w_hash").alias("h"))
    theirs = found.where(F.size("w") > 0).select(F.col("of_rid").alias("rid"), F.col("of_doc_id").alias("doc_id"), F.col("os").alias("s"), F.col("oe").alias("e")).distinct()
    theirs = theirs.join(with_windows(around.where("crowd")), ["rid", "s", "e"]).select("rid", "doc_id", opened).select("rid", "doc_id", "x.w", "x.w_hash")
    first = ours.union(theirs).groupBy("h").agg(F.min(F.struct("doc_id", "rid", "s")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = shared.stage(first.select("h", F.col("f.rid").alias("of_rid"), F.col("f.doc_id").alias("of_doc_id"), F.col("f.s").alias("of_s")), "windows")
    again = ours.join(first, "h").where(f"rid != of_rid OR s - of_s >= {MIN_WORDS}")
    return again.select("rid", "doc_id", "s", (F.col("s") + MIN_WORDS).alias("e"), "of_rid", "of_doc_id", (F.col("s") - F.col("of_s")).alias("shift"), F.lit(True).alias("crowd")), first


def with_windows(spots: DataFrame) -> DataFrame:
    """``spots`` with ``w``, the starts of their windows as ``windows`` has them."""
    low, high = f"greatest(0, s - {MIN_WORDS - BLOCK})", f"least(e - {BLOCK}, words - {MIN_WORDS})"
    every = f"CASE WHEN crowd AND {low} <= {high} THEN sequence({low}, {high}) ELSE cast(array() AS array<int>) END"
    return spots.withColumn("w", F.expr(f"filter({every}, w -> w < s OR w + {MIN_WORDS} > e)"))


def looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, s, e, own, first, left, right, grams, crowd, words, w_hash) for wanted (rid, s, e, own, first, whole, crowd).

    For own spots, which are compared with a first occurrence, and for first ones, ``left`` and ``right`` are the words before s,
    nearest first, and from e on, ``REACH`` each; for whole ones ``grams`` are the distinct shingle hashes between; for crowded
    ones ``w_hash`` the hashes of the windows of ``MIN_WORDS`` words that share a block with s..e and leave it.
    ``words`` is the length of the text."""
    kinds = ["own", "first", "whole", "crowd"]
    asked = wanted.groupBy("rid", "s", "e").agg(*[F.max(k).alias(k) for k in kinds]).groupBy("rid").agg(
        F.collect_list(F.struct("s", "e", *kinds)).alias("asked")
    )
    texts = docs.select(row_hash().alias("rid"), "text").join(asked, "rid").dropDuplicates(["rid"])

    def make():
        def work(columns):
            out = {k: [] for k in ("rid", "s", "e", "own", "first", "left", "right", "grams", "crowd", "words", "w_hash")}
            for rid, text, spots in zip(*columns):
                lines = split(text or "")
                flat = list(chain.from_iterable(lines))
                codes = word_codes(lines)
                h = shingle_hashes(codes)
                near = [windows(x["s"], x["e"], len(codes)) if x["crowd"] else codes[:0].view("i8") for x in spots]
                hashes = np.split(window_hashes(h, np.concatenate(near)), np.cumsum([len(w) for w in near])[:-1])
                for spot, w_hash in zip(spots, hashes):
                    s, e = spot["s"], spot["e"]
                    grams = np.unique(h[s : e - SHINGLE + 1]).view("i8") if spot["whole"] else None
                    around = (in_text(flat[max(0, s - REACH) : s][::-1]), in_text(flat[e : e + REACH])) if spot["own"] or spot["first"] else (None, None)
                    for k, v in zip(out, (rid, s, e, spot["own"], spot["first"], *around, grams, spot["crowd"], len(codes), w_hash)):
                        out[k].append(v)
            return out

        return work

    return shared.map_rows(
        texts, make, "rid long, s int, e int, own boolean, first boolean, left string, right string, grams array<long>, crowd boolean, words int, w_hash array<long>"
    )


def words_of(text: str) -> Column:
    """The words of a column that ``in_text`` made."""
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def same_length(a: str, b: str) -> str:
    """SQL for the number of leading equal elements of two arrays."""
    at = f"array_position(zip_with({a}, {b}, (x, y) -> x = y), false)"  # beyond the shorter one x = y is null, not false
    return f"coalesce(cast(nullif({at}, 0) AS int) - 1, least(size({a}), size({b})))"


SPAN = ["rid", "doc_id", "s", "e", "of_rid", "of_doc_id", "of_s", "component"]


def companions(lines: DataFrame, met: DataFrame) -> DataFrame:
    """(h, met, doc_id, rid, s, e): first occurrence of each paragraph that has an equal one or met a different one in a band."""
    each = lines.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "s", "e")).alias("f"))
    names = met.select("h").distinct().withColumn("met", F.lit(True))
    return each.join(names, "h", "left").where("n > 1 OR met").select("h", F.coalesce("met", F.lit(False)).alias("met"), "f.*")


def repeated_paragraphs(heads: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """Spans of all paragraphs of a component but its first; a paragraph without links is a component with its equals."""
    named = heads.join(groups, "h", "left").withColumn("component", F.coalesce("component", "h"))
    kept = named.groupBy("component").agg(F.min(F.struct("doc_id", "rid", "s")).alias("f"))
    named = shared.stage(named.join(kept, "component").select("h", "component", F.col("f.rid").alias("of_rid"), F.col("f.doc_id").alias("of_doc_id"), F.col("f.s").alias("of_s")), "named")
    return held.join(named, "h").where("rid != of_rid OR s != of_s").select(SPAN)


def removals(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, s, e, of_rid, of_doc_id, of_s, component): word spans to remove, each with the copy that stays, as a staged table.

    ``component`` names the component of a paragraph; for passages it is null.
    """
    staged = shared.stage(units(docs), "units")
    found = runs(staged)
    met = shared.stage(collisions(staged), "met")
    lines = paragraphs(staged)
    heads = shared.stage(companions(lines, met), "heads")
    held = shared.stage(lines.join(heads.select("h"), "h"), "held")
    shared.drop_stage(staged)
    firsts = heads.where("met")
    yes, no = F.lit(True), F.lit(False)
    wanted = found.select("rid", "s", "e", yes.alias("own"), no.alias("first"), no.alias("whole"), "crowd").union(
        found.select("of_rid", F.col("s") - F.col("shift"), F.col("e") - F.col("shift"), no, yes, no, "crowd")
    ).union(firsts.select("rid", "s", "e", no, no, yes, no))
    around = shared.stage(looked_up(docs, wanted), "around")

    ours = around.where("own").select("rid", "s", "e", F.col("left").alias("l1"), F.col("right").alias("r1"), "words", "w_hash")
    theirs = around.where("first").select(F.col("rid").alias("of_rid"), F.col("s").alias("os"), F.col("e").alias("oe"), F.col("left").alias("l2"), F.col("right").alias("r2"))
    matched = found.withColumn("os", F.col("s") - F.col("shift")).withColumn("oe", F.col("e") - F.col("shift")).join(ours, ["rid", "s", "e"]).join(
        theirs, ["of_rid", "os", "oe"]
    ).withColumns({c: words_of(c) for c in ("l1", "r1", "l2", "r2")}).withColumn("before", F.expr(same_length("l1", "l2"))).withColumn("after", F.expr(same_length("r1", "r2")))
    left_over = f"filter(arrays_zip(w, w_hash), x -> x.w < s - before OR x.w + {MIN_WORDS} > e + after)"
    matched = with_windows(matched).withColumn("x", F.expr(left_over)).select(
        "rid", "doc_id", "s", "e", "before", "after", "of_rid", "of_doc_id", "os", "oe", "shift", "crowd", F.col("x.w").alias("w"), F.col("x.w_hash").alias("w_hash")
    )
    matched = shared.stage(matched, "matched")
    shared.drop_stage(found)
    direct = touching(matched.select(
        "rid", "doc_id", (F.col("s") - F.col("before")).alias("s"), (F.col("e") + F.col("after")).alias("e"), "of_rid", "of_doc_id", "shift", "crowd"
    )).where(F.col("e") - F.col("s") >= MIN_WORDS)
    direct = shared.stage(direct, "direct")
    within = [F.col("w.rid") == F.col("c.rid"), F.col("c.from") <= F.col("w.s"), F.col("w.e") <= F.col("c.to")]
    beside, window_heads = elsewhere(matched, around)
    rest = beside.alias("w").join(covered(direct).alias("c"), within, "left_anti")
    passages = touching(direct.union(rest)).withColumns({"of_s": F.col("s") - F.col("shift"), "component": F.lit(None).cast("long")})
    passages = shared.stage(passages.select(SPAN), "passages")
    shared.drop_stage(matched, direct, window_heads)

    grams = shared.stage(firsts.join(around.select("rid", "s", "e", "grams"), ["rid", "s", "e"]).select("h", "grams"), "grams")
    shared.drop_stage(around)
    groups = shared.stage(shared.components(near(met, grams), "h", "other"), "groups").select(F.col("node").alias("h"), "component")
    shared.drop_stage(met, grams)
    both = passages.union(repeated_paragraphs(heads, held, groups)).groupBy(SPAN[:-1]).agg(F.max("component").alias("component"))
    spans = shared.stage(both, "spans")
    shared.drop_stage(passages, heads, held)
    return spans


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space behind each span."""
    raw = text.encode("utf-8")
    at = np.array([m.span() for m in WORD.finditer(raw)], "i8")
    gone = np.zeros(len(at) + 1, bool)
    for s, e in spans:
        gone[s:e] = True
    out, last = [], 0
    edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    bounds = [0, *edges.tolist()] if gone[0] else edges.tolist()
    for s, e in zip(bounds[::2], bounds[1::2]):
        out.append(raw[last : at[s][0]])
        last = at[e][0] if e < len(at) else len(raw)
    return b"".join([*out, raw[last:]]).decode("utf-8")


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``."""
    rid, cuts = (shared.free_name(docs.columns, n) for n in ("_rid", "_spans"))
    held = spans.groupBy(F.col("rid").alias(rid)).agg(F.collect_set(F.struct("s", "e")).alias(cuts))
    joined = docs.withColumn(rid, row_hash()).join(held, rid, "left")
    at, names = docs.columns.index("text"), docs.columns
    target = docs.schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for part in shared.slices(batch):
                texts = [
                    cut(t, [(x["s"], x["e"]) for x in sp]) if t is not None and sp else t
                    for t, sp in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist())
                ]
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(texts, "string")
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return shared.map_arrow(joined.select(*names, cuts), run, target)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return removals(docs).select(
        "doc_id", F.col("s").alias("start_word"), (F.col("e") - F.col("s")).alias("n_words"), F.col("of_doc_id").alias("kept_doc_id"), F.col("of_s").alias("kept_start_word"), F.col("component").alias("component_id")
    )
