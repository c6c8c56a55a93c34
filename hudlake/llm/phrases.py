"""Phrase collocations: frequent phrases of each language, scored by their weakest cut.

Words are counted by language first; a phrase that occurs ``least`` times has only words, and
contiguous parts, that occur as often (the Apriori rule). So the words of that frequency get slots of a minimal perfect hash
(see ``slots``), stored keys being 128-bit hashes of language and word, and texts become arrays of slots, a break
wherever a piece ends or a rarer word stands. Then, for each length in turn, tasks list the phrases
whose two parts one word shorter are both frequent, combined inside the task; those that reach ``least`` in sum are the
candidates of that length. A candidate's key is (slot of its first words, slot of its last word) as one exact number, so no hash
stands for a phrase. The candidates get slots in turn, tasks count their occurrences with ``bincount`` by slot while they
replace positions by slots for the next length, and the arrays are summed in a tree. All parts of a candidate are candidates or
frequent words themselves, so both sides of each cut are read by slot, from the candidate's two parts: counts of its
beginnings come with the part without the last word, counts of its ends with the part without the first.

A longer candidate around a phrase occurs at most as often as one that is longer by one word, so a phrase needs comparing
with those alone.

Nothing grows in the driver; a task holds one part of a slot table, ``SEEN`` distinct phrases and one run of
texts. Defined cases: a null text counts as empty; a null language is ``und``, together with rows that say so; null ids and repeated
rows count like others, each row once; a very long text is read whole, by one task; ties in all of score, count and
phrase cannot be, for a phrase occurs once a language; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hudlake.llm import shared
from hudlake.llm.slots import ARRAYS, Keys, Tally, added, place

LEAST, LONGEST, ABSORBED, MOST = 30, 4, 80, 2000
UNKNOWN = "und"
#: Distinct words or phrases that a task combines before it passes them on, and slots that one row of positions gathers.
SEEN, ROW_WORDS = 1 << 18, 1 << 16
MEMO_WORDS = 100_000
#: Buckets that phrases are dealt into, at least.
LEAST_BUCKETS = 64
#: Bytes of texts that a task cuts into words at a time.
TEXT_BYTES = 1 << 20
BREAK, NOTHING = -1, -2
END = b"\n"
#: Narrow and wide types of steps between keys and of counts.
KEYS, TIMES = ("<u4", "<u8"), ("<u1", "<i8")

#: A-Z in lower case; ends of pieces, [.,;:!?\x0A-\x0D], as one byte; the tab as a space.
BYTES = bytes(END[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def marked(text: bytes | None) -> list[bytes]:
    """Words of a text in order, ``END`` where a piece ends, and empty strings, which mean nothing."""
    return (text or b"").translate(BYTES).replace(END, b" \n ").split(b" ")


def word_key(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    head = lang.encode()
    head = len(head).to_bytes(4, "little") + head
    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(head + w) for w in words]), "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word binary, n) of rows (lang, raw)."""

    def run(batches):
        import pyarrow as pa

        seen: dict[str, Counter] = {}

        def out() -> Iterator:
            for lang, words in seen.items():
                for nothing in (b"", END):
                    words.pop(nothing, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), "string"), "word": pa.array(list(words), "binary"), "n": pa.array(list(words.values()), "int64")})

        for batch in batches:
            for part in shared.slices(batch, size=TEXT_BYTES):
                for lang, raw in zip(*(c.to_pylist() for c in part.columns)):
                    seen.setdefault(lang, Counter()).update(marked(raw))
                if sum(map(len, seen.values())) > SEEN:
                    yield from out()
                    seen.clear()
        yield from out()

    return shared.map_arrow(docs, run, "lang string, word binary, n long", __name__).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def keyed_words(words: DataFrame) -> DataFrame:
    def make():
        def work(columns):
            langs, raws = columns
            x, y = np.zeros(len(raws), "u8"), np.zeros(len(raws), "u8")
            for lang in set(langs):
                mine = [i for i, k in enumerate(langs) if k == lang]
                x[mine], y[mine] = word_key(lang, [raws[i] for i in mine])
            return {"lang": langs, "word": raws, "x": x.view("i8"), "y": y.view("i8")}

        return work

    return shared.map_rows(words.select("lang", "word"), make, "lang string, word binary, x long, y long", rows=10_000, owner=__name__)


def slotted(table: DataFrame, keys: Keys) -> DataFrame:
    """``table`` (with columns x, y) with each row's slot."""
    from pyspark.sql.types import LongType, StructField, StructType

    target = StructType([*table.schema.fields, StructField("slot", LongType())])
    ax, ay = table.columns.index("x"), table.columns.index("y")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (ax, ay))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.slots(x, y))], schema=arrow)

    return shared.map_arrow(table, run, target, keys.path)


POSITIONS = f"words binary, parts binary, {ARRAYS}"


def slot_type(slots: int) -> str:
    """Type in which positions hold ``slots`` slots and -1."""
    return "<i4" if slots < 1 << 31 else "<i8"


def rows_out(words: bytes | None, parts: bytes | None, arrays: list):
    import pyarrow as pa

    n = len(arrays) or 1
    lone = [words, parts]
    at, part, counts = zip(*arrays) if arrays else ([None],) * 3
    return pa.RecordBatch.from_arrays(
        [pa.array([v] * n, "binary") for v in lone] + [pa.array(at, "int64"), pa.array(part, "int32"), pa.array(counts, "binary")],
        names=["words", "parts", "at", "part", "counts"],
    )


def word_positions(docs: DataFrame, keys: Keys) -> DataFrame:
    """``POSITIONS`` rows: arrays of word slots (``parts`` is null: the phrases are the words), and counts by slot."""

    def run(batches):
        from pyspark import TaskContext

        tally, memo = Tally(keys, TaskContext.get().partitionId()), {}
        held, size = [], 0

        def out():
            nonlocal held, size
            ids = np.concatenate(held).astype(slot_type(keys.total)).tobytes()
            held, size = [], 0
            return rows_out(ids, None, [])

        for batch in batches:
            for part in shared.slices(batch, size=TEXT_BYTES):
                texts = [(lang, marked(raw)) for lang, raw in zip(*(c.to_pylist() for c in part.columns))]
                if sum(map(len, memo.values())) > MEMO_WORDS:
                    memo.clear()
                new: dict[str, set] = {}
                for lang, words in texts:
                    known = memo.setdefault(lang, {b"": NOTHING, END: BREAK})
                    new.setdefault(lang, set()).update(w for w in set(words) if w not in known)
                for lang, words in new.items():
                    if words:
                        names = list(words)
                        memo[lang].update(zip(names, keys.slots(*word_key(lang, names)).tolist()))
                ids = [np.array([BREAK], "i8")]
                for lang, words in texts:
                    own = np.fromiter(map(memo[lang].__getitem__, words), "i8", len(words))
                    ids += [own[own != NOTHING], np.array([BREAK], "i8")]
                flat = np.concatenate(ids)
                found = flat[flat >= 0]
                for p, (base, n) in enumerate(zip(keys.bases, keys.sizes)):
                    mine = found[(found >= base) & (found < base + n)] - base
                    if mine.size:
                        tally.add(p, mine, None)
                held.append(flat[1:][(flat[1:] >= 0) | (flat[:-1] >= 0)])  # breaks side by side are one
                size += len(held[-1])
                if size >= ROW_WORDS:
                    yield out()
                for rows in tally.take():
                    yield rows_out(None, None, rows)
        if size:
            yield out()
        tally.flush()
        for rows in tally.take():
            yield rows_out(None, None, rows)

    return shared.map_arrow(docs, run, POSITIONS, keys.path)


def occurrences(words: np.ndarray, parts: np.ndarray, length: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases of ``length`` words begin whose two parts of ``length`` - 1 words are frequent; their keys; slots of their ends.

    ``parts`` has the slot of the phrase of ``length`` - 1 words that begins at each position, or -1.
    """
    at = np.flatnonzero((parts[:-1] >= 0) & (parts[1:] >= 0))
    return at, parts[at].astype("i8") * n_words + words[at + length - 1], parts[at + 1].astype("i8")


def opened(raw: tuple[bytes, bytes | None], n_words: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(raw[0], slot_type(n_words))
    return words, words if raw[1] is None else np.frombuffer(raw[1], slot_type(n_parts))


def candidates(positions: DataFrame, length: int, n_words: int, n_parts: int, least: int, buckets: int) -> DataFrame:
    """(x, ends, n): keys of the phrases of ``length`` words with n >= ``least``, slots of their parts without the first word.

    Tasks combine what they see, deal it into ``buckets`` by key and pass arrays on, a row for each bucket; a bucket's arrays
    are added up together. With a bucket for each ``SEEN`` words of the table, none holds more than some ``SEEN`` keys.
    """

    kind = slot_type(n_parts)

    def pack(x, ends, n):
        """Steps of the ascending keys and counts, each as narrow as they allow; a phrase of two words ends in its last word."""
        steps = np.diff(x, prepend=x[:1])
        wide = int(steps.max()) >= 1 << 32, int(n.max()) >= 1 << 8
        head = len(x).to_bytes(4, "little") + int(x[0]).to_bytes(8, "little") + bytes(wide)
        return head + steps.astype(KEYS[wide[0]]).tobytes() + n.astype(TIMES[wide[1]]).tobytes() + (ends.astype(kind).tobytes() if length > 2 else b"")

    def unpack(raw):
        many, first, a, b, at = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:12], "little"), raw[12], raw[13], 14
        x = first + np.cumsum(np.frombuffer(raw, KEYS[a], many, at).astype("i8"))
        at += many * int(KEYS[a][2])
        n = np.frombuffer(raw, TIMES[b], many, at).astype("i8")
        at += many * int(TIMES[b][2])
        return x, np.frombuffer(raw, kind, many, at).astype("i8") if length > 2 else x % n_words, n

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def out(found):
            x, ends, n = found
            bucket = place(x.view("u8"), np.zeros(len(x), "u8"), length, buckets).astype("i8")
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            many = max(1, (len(cuts) - 1) * ROW_WORDS // max(1, len(x)))  # rows of a batch: some 24 * ROW_WORDS bytes
            for lo in range(0, len(cuts) - 1, many):
                mine = [(int(bucket[order[i]]), order[i:j]) for i, j in zip(cuts[lo : lo + many], cuts[lo + 1 : lo + many + 1])]
                yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in mine], "found": pa.array([pack(x[o], ends[o], n[o]) for _, o in mine], "binary")})

        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                _, x, ends = occurrences(*opened(raw, n_words, n_parts), length, n_words)
                x, first, n = np.unique(x, return_index=True, return_counts=True)
                held.append((x, ends[first], n))
                size += len(x)
                if size > 2 * SEEN:
                    found = summed(held)
                    held, size = [found], len(found[0])
                    if size > SEEN:
                        yield from out(found)
                        held, size = [], 0
        if held:
            yield from out(summed(held))

    def add(group):
        import pyarrow as pa

        x, ends, n = summed([unpack(v.as_py()) for v in group.column("found")])
        kept = n >= least
        return pa.table({"x": x[kept], "ends": ends[kept], "n": n[kept]})

    found = shared.map_arrow(positions.where("words IS NOT NULL").select("words", "parts"), run, "bucket long, found binary", __name__)
    return found.groupBy("bucket").applyInArrow(add, "x long, ends long, n long")


def summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys once each, their ends, and their counts in sum, of several (keys, ends, counts)."""
    x, ends, n = (np.concatenate(c) for c in zip(*parts))
    x, first, group = np.unique(x, return_index=True, return_inverse=True)
    total = np.zeros(len(x), "i8")
    np.add.at(total, group, n)
    return x, ends[first], total


def phrase_positions(positions: DataFrame, keys: Keys, length: int, n_words: int, n_parts: int) -> DataFrame:
    """``POSITIONS`` rows for phrases of ``length`` words, from those of phrases one word shorter."""

    def run(batches):
        from pyspark import TaskContext

        tally = Tally(keys, TaskContext.get().partitionId())
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                words, parts = opened(raw, n_words, n_parts)
                at, x, _ = occurrences(words, parts, length, n_words)
                own = np.full(len(words), BREAK, slot_type(keys.total))
                own[at] = keys.slots(x, np.zeros(len(x), "i8"), tally)
                if (own >= 0).any():
                    yield rows_out(raw[0], own.tobytes(), [])
                for rows in tally.take():
                    yield rows_out(None, None, rows)
        tally.flush()
        for rows in tally.take():
            yield rows_out(None, None, rows)

    return shared.map_arrow(positions.where("words IS NOT NULL").select("words", "parts"), run, POSITIONS, keys.path)


def counted(positions: DataFrame) -> DataFrame:
    return added(positions.where("counts IS NOT NULL").select("at", "part", "counts"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... ``longest`` words, and (lang, n) with all words of a language.

    A table has (slot, lang, phrase, f, begins, rests, pre, ends): counts of the phrase's first 1, 2, ... words, counts of
    its last all, all but one, ... words, and the slots of the parts without the last and without the first word.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("raw"))
    counts = shared.stage(word_counts(rows), "word-counts")
    totals = shared.stage(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(LEAST_BUCKETS, -(-(counts.agg(F.sum("n")).first()[0] or 0) // SEEN))
    words = shared.stage(keyed_words(counts.where(F.col("n") >= least)), "words")
    shared.drop_stage(counts)
    keys = Keys(words, "word-keys")
    n_words = keys.total
    positions = shared.stage(word_positions(rows, keys), "positions", "zstd")
    f = F.array("f")
    level = slotted(words, keys).join(counted(positions), "slot").select(
        "slot", "lang", F.col("word").cast("string").alias("phrase"), "f", f.alias("begins"), f.alias("rests"), F.lit(-1).cast("long").alias("pre"), F.lit(-1).cast("long").alias("ends")
    )
    levels = [shared.stage(level, "phrases")]
    keys.drop(words)
    for length in range(2, longest + 1):
        n_parts = keys.total
        found = candidates(positions, length, n_words, n_parts, least, buckets).select("x", F.lit(0).cast("long").alias("y"), "ends")
        found = shared.stage(found, "candidates")
        keys = Keys(found, "phrase-keys")
        after = shared.stage(phrase_positions(positions, keys, length, n_words, n_parts), "positions", "zstd")
        one = slotted(found, keys).join(counted(after), "slot").select("slot", F.expr(f"x div {max(1, n_words)}").alias("pre"), "ends", "f")
        short = levels[-1]
        left = short.select(F.col("slot").alias("pre"), "lang", F.col("phrase").alias("head"), "begins")
        right = short.select(F.col("slot").alias("ends"), F.substring_index("phrase", " ", -1).alias("last"), F.col("rests").alias("after"))
        level = one.join(left, "pre").join(right, "ends").select(
            "slot", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", F.concat("begins", f).alias("begins"), F.concat(f, "after").alias("rests"), "pre", "ends"
        )
        levels.append(shared.stage(level, "phrases"))
        keys.drop(found)
        shared.drop_stage(positions, found)
        positions = after
    shared.drop_stage(positions, words)
    return levels, totals


def scored(levels: list[DataFrame], absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one absorbs."""
    out = None
    for k, level in enumerate(levels[1:], 2):
        cut = "struct(cast((2000000BD * f) div (cast(begins[{i}] AS decimal(20)) + rests[{j}]) AS long) AS score, {j} AS cut, begins[{i}] AS l, rests[{j}] AS r)"
        cuts = ", ".join(cut.format(i=j - 1, j=j) for j in range(1, k))
        one = level.select("slot", "lang", "phrase", F.col("f").alias("a"), F.expr(f"array_min(array({cuts}))").alias("c"))
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("pre", "ends")).alias("slot"), "f").groupBy("slot").agg(F.max("f").alias("longer"))
            one = one.join(longer, "slot", "left").where(F.expr(f"longer IS NULL OR 100BD * longer < {absorbed}BD * a"))
        one = one.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        out = one if out is None else out.union(one)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to ``longest`` words of each language."""
    levels, totals = mine(docs, text, lang, least, longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(levels, absorbed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents").select("text", "lang"))


def _oracle() -> str:
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lists = "\n  UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])) AS p FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    return f"""
WITH cut AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{big}', '{small}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
spots AS ({lists}),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.k, c.f AS a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inside AS (
  SELECT o.lang, o.p[i:i + s - 1] AS p, max(o.f) AS longer
  FROM (SELECT *, unnest(range(2, k)) AS s FROM f WHERE k > 2) o, LATERAL (SELECT unnest(range(1, o.k - o.s + 2)) AS i) t GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.p
  WHERE i.longer IS NULL OR 100 * i.longer < {ABSORBED} * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN totals USING (lang) QUALIFY rank <= {MOST}
"""


OP13_SQL = _oracle()
