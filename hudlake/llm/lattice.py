"""Piece lattices over a SentencePiece vocabulary: marginal likelihood and sampled segmentations.

The vocabulary file states a score per piece; in a byte-pair file the scores are negated merge ranks,
which are turned into log probabilities by Zipf's law: a piece of rank r weighs 1 / (r + ``SHIFT``).
Characters outside the vocabulary are spelled by byte pieces, each weighing as much as a piece after
the last rank. One more event ends a text and weighs as much as a piece of rank ``END_RANK``, so that a
text has some ``END_RANK * ln(pieces)`` pieces to be expected and the probabilities of all texts sum to
1 at most. (They fall short by what spells no text: byte pieces out of order, or in place of pieces.)
``Weights`` learned from texts may take the place of all these: counts of the pieces, of the end, and of frequent segments
(see below), each of which is one more piece that spans its whole segment.
A space is written as U+2581 in the file; a text's own U+2581 is not a space and is
spelled in bytes, so that decoding restores it. One space is put before every text, as the
vocabulary's word-initial pieces expect, and taken off again by decoding.

No piece runs on from a non-space to a space or over a line feed, so the lattice of a text falls apart
into the lattices of its segments: runs of spaces with the word behind them. The distinct segments of
a batch of texts get their lattices together, as arrays: pieces are found by rolling hashes of all
substrings that begin some piece, and the forward recursion runs over all segments at a time, one
place after another. Batches are bounded in characters (``BATCH_CHARS``); a longer text is taken in
parts, segment by segment, so that only a single segment (a word without a space) can exceed the bound.
"""

from __future__ import annotations

import re
from copy import copy
from dataclasses import dataclass
from itertools import chain
from math import log

import numpy as np

from hudlake.llm.shared import resident

SHIFT, END_RANK = 2.7, 50
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
BATCH_CHARS = 250_000
#: Rows that a worker takes up at a time: enough to fill a batch.
BATCH_ROWS = 1024
#: Segments whose probabilities are remembered between batches, and the longest of them.
MOST_SEGMENTS, LONGEST_SEGMENT = 300_000, 64
SLOTS = 20
SPACE = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Weights:
    """Natural logs of learned probabilities: by piece id, of a byte piece, of the end, and by whole segment."""

    name: str
    pieces: np.ndarray
    byte: float
    end: float
    whole: dict[str, float]


class Vocabulary:
    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte = [i for i in range(size) if sp.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("the vocabulary must spell every byte")
        scores = {i: sp.get_score(i) for i in plain}
        usable = [i for i in plain if scores[i] > -1e8]
        ranks = {i: r for r, i in enumerate(sorted(usable, key=lambda i: -scores[i]))}
        last = 1 / (len(ranks) + SHIFT)
        shown = {sp.id_to_piece(i).replace(SPACE, " "): (i, 1 / (r + SHIFT)) for i, r in ranks.items()}
        for p in [" " * k for k in range(1, 17)]:  # runs of spaces stand at the end of the file with no merge rank
            i = sp.piece_to_id(p.replace(" ", SPACE))
            if p not in shown and sp.id_to_piece(i) == p.replace(" ", SPACE):
                shown[p] = (i, last)
        end = 1 / (END_RANK + SHIFT)
        total = sum(w for _, w in shown.values()) + 256 * last + end
        self.size = size
        self.pieces = {p: (i, log(w / total)) for p, (i, w) in shown.items()}
        self.byte_ids = byte
        self.byte_log, self.end_log = log(last / total), log(end / total)
        self.whole: dict[str, float] = {}
        self.bytes_of = [b""] * size
        for p, (i, _) in self.pieces.items():
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(byte):
            self.bytes_of[i] = bytes([b])
        self.longest = max(map(len, self.pieces))
        prefixes = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        none = (-1, 0.0)
        self.piece_at = np.array([self.pieces.get(p, none)[0] for p in prefixes], "i8")
        self.log_at = np.array([self.pieces.get(p, none)[1] for p in prefixes])
        self.hash_at = np.zeros(len(prefixes), "u8")
        for length in {len(p) for p in prefixes}:
            mine = [i for i, p in enumerate(prefixes) if len(p) == length]
            codes, h = code_points("".join(prefixes[i] for i in mine)).reshape(-1, length), np.zeros(len(mine), "u8")
            for k in range(length):
                h = roll(h, codes[:, k])
            self.hash_at[mine] = h
        self.table, self.probes = np.full((1 << SLOTS) + 64, -1, "i4"), 1
        for i, slot in enumerate((self.hash_at >> np.uint64(64 - SLOTS)).tolist()):
            step = 0
            while self.table[slot + step] >= 0:
                step += 1
            self.table[slot + step] = i
            self.probes = max(self.probes, step + 1)

    def weighted(self, w: Weights) -> Vocabulary:
        """The same pieces with other weights, and with whole segments beside them."""
        out = copy(self)
        out.pieces = {p: (i, float(w.pieces[i])) for p, (i, _) in self.pieces.items()}
        out.log_at = np.where(self.piece_at >= 0, w.pieces[self.piece_at], 0.0)
        out.byte_log, out.end_log, out.whole = w.byte, w.end, w.whole
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the prefix of each hash, or -1."""
        slot, out, left = h >> np.uint64(64 - SLOTS), np.full(len(h), -1, "i4"), np.arange(len(h))
        for k in range(self.probes):
            entry = self.table[slot[left] + np.uint64(k)]
            hit = (entry >= 0) & (self.hash_at[entry] == h[left])
            out[left[hit]] = entry[hit]
            left = left[~hit & (entry >= 0)]
            if not left.size:
                break
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")


def roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h + codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return z ^ z >> np.uint64(32)


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable sorting order of small numbers, 16 bits a step: NumPy sorts those by radix."""
    order = np.argsort(x.astype("u2"), kind="stable")
    for shift in range(16, int(x.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((x[order] >> shift).astype("u2"), kind="stable")]
    return order


class Lattices:
    """The lattices of distinct segments. A node is the place behind a character; nodes are numbered by
    place first and segment second, and the edges into a node stand together in node order."""

    def __init__(self, v: Vocabulary, segments: list[str]):
        codes = code_points("".join(segments))
        n = np.fromiter(map(len, segments), "i8", len(segments))
        self.length, total = n, len(codes)
        start = np.cumsum(n) - n
        place = np.arange(total) - np.repeat(start, n)
        room = np.repeat(n, n) - place
        order = stable_order(place)
        node = np.empty(total, "i8")
        node[order] = np.arange(total)
        self.place = place[order] + 1
        self.last = node[start + n - 1] if total else np.zeros(0, "i8")
        begins, ends, piece, weight = [], [], [], []
        live, h = np.arange(total), np.zeros(total, "u8")
        for size in range(1, v.longest + 1):
            fits = room[live] >= size
            live, h = live[fits], h[fits]
            if not live.size:
                break
            h = roll(h, codes[live + size - 1])
            entry = v.find(h)
            known = (entry >= 0) & (v.piece_at[entry] >= 0)
            begins.append(live[known])
            ends.append(live[known] + size - 1)
            piece.append(v.piece_at[entry[known]])
            weight.append(v.log_at[entry[known]])
            if size == 1:  # characters without a piece are spelled in bytes; marked by their code points
                other = live[~known]
                begins.append(other)
                ends.append(other)
                piece.append(-codes[other].astype("i8"))
                weight.append(utf8_bytes(codes[other]) * v.byte_log)
            live, h = live[entry >= 0], h[entry >= 0]
        begins, ends, piece, weight = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (begins, ends, piece, weight))
        sort = stable_order(node[ends]) if total else np.zeros(0, "i8")
        begins, self.piece, weight = begins[sort], piece[sort], weight[sort]
        self.source = np.where(place[begins] > 0, node[begins - 1], -1) if total else begins
        self.node = node[ends[sort]] if total else begins
        self.first = first = np.concatenate([[0], np.cumsum(np.bincount(self.node, minlength=total))])
        # forward filtering, place by place
        self.alpha, self.value = np.zeros(total), np.zeros(len(begins))
        levels = np.searchsorted(self.place, np.arange(1, (int(n.max()) if len(n) else 0) + 2))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            to = slice(first[a], first[b])
            source = self.source[to]
            value = weight[to] + np.where(source >= 0, self.alpha[source], 0.0)
            cuts, own = first[a:b] - first[a], self.node[to] - a
            top = np.maximum.reduceat(value, cuts)
            self.alpha[a:b] = top + np.log(np.add.reduceat(np.exp(value - top[own]), cuts))
            self.value[to] = value

    def marginals(self) -> np.ndarray:
        """Log probability of each segment over all its segmentations."""
        return self.alpha[self.last]

    def expected(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Pieces and how often each is expected, and byte pieces in all, if every segment occurs so many times: the backward pass."""
        chance, mass = np.exp(self.value - self.alpha[self.node]), np.zeros(len(self.alpha))
        mass[self.last] = times
        levels = np.searchsorted(self.place, np.arange(1, int(self.length.max(initial=0)) + 2))
        for a, b in zip(levels[-2::-1].tolist(), levels[:0:-1].tolist()):
            into = slice(self.first[a], self.first[b])
            chance[into] *= mass[self.node[into]]
            source = self.source[into]
            np.add.at(mass, source[source >= 0], chance[into][source >= 0])
        plain = self.piece > 0
        spelled = utf8_bytes(-self.piece[~plain]) * chance[~plain]
        count = np.bincount(self.piece[plain], chance[plain])
        some = np.flatnonzero(count)
        return some, count[some], float(spelled.sum())

    def keys(self) -> np.ndarray:
        """For each edge, its node's number plus the cumulative probability of the node's edges up to it."""
        chance = np.exp(self.value - self.alpha[self.node])
        total = np.cumsum(chance)
        starts = self.first[self.node]
        out = self.node + (total - (total[starts] - chance[starts]))
        final = np.flatnonzero(np.diff(self.node, append=-1) != 0)
        out[final] = self.node[final] + 1.0
        return out


def utf8_bytes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype("i8") + (codes > 0x7FF) + (codes > 0xFFFF)


def ranges(sizes: list[int]):
    """Ranges of items that hold ``BATCH_CHARS`` characters together, or one item each."""
    ends, at = np.cumsum(np.array(sizes, "i8")), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BATCH_CHARS, "right")))
        yield at, stop
        at = stop


def segments(text: str | None) -> list[str]:
    """What ``SEGMENT`` finds; where no two spaces meet, by cuts before spaces and around line feeds, which is faster."""
    if not text:
        return []
    text = " " + text
    if "  " in text or "\0" in text:
        return SEGMENT.findall(text)
    return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


class Marginals(dict):
    """Log10 probability by segment."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.vocabulary = v

    def texts(self, texts: list[str | None]) -> list[float]:
        """Log10 of the probability of each text and its end, summed over all its segmentations."""
        out: list[float] = []
        for a, b in ranges([len(t or "") for t in texts]):
            cut = [segments(t) for t in texts[a:b]]
            if len(self) > MOST_SEGMENTS:
                self.clear()
            new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self]
            for i, j in ranges(list(map(len, new))):
                lp = Lattices(self.vocabulary, new[i:j]).marginals()
                if self.vocabulary.whole:
                    lp = np.logaddexp(lp, [self.vocabulary.whole.get(s, -np.inf) for s in new[i:j]])
                self.update(zip(new[i:j], (lp / log(10)).tolist()))
            out += [float(sum(map(self.__getitem__, c))) + self.vocabulary.end_log / log(10) for c in cut]
            for s in new:
                if len(s) > LONGEST_SEGMENT:
                    del self[s]
        return out

    def text(self, text: str | None) -> float:
        return self.texts([text])[0]


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on seed and counter alone (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        z = seed + (counter.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(24)) * 2.0**-40


class Sampler:
    """Forward-filtering backward-sampling, for all segments of a batch at a time: a step draws the edge into
    every open segment's node whose key is the first above the draw."""

    def __init__(self, v: Vocabulary):
        self.vocabulary = v
        self.byte_ids = np.array(v.byte_ids)

    def sample(self, texts: list[str | None], seeds: np.ndarray) -> list[bytes]:
        """A drawn segmentation of each text, as little-endian unsigned 32-bit piece ids."""
        return [x for a, b in ranges([len(t or "") for t in texts]) for x in self._sample(texts[a:b], seeds[a:b])]

    def _sample(self, texts: list[str | None], seeds: np.ndarray) -> list[bytes]:
        cut = [segments(t) for t in texts]
        flat = [s for c in cut for s in c]
        sizes = np.array([len(c) for c in cut], "i8")
        seed, owner = np.repeat(seeds.astype("u8"), sizes), np.repeat(np.arange(len(texts)), sizes)
        length = np.fromiter(map(len, flat), "i8", len(flat))
        begin = np.concatenate([[0], np.cumsum(length)])
        start = begin[:-1] - begin[np.cumsum(sizes) - sizes][owner]  # of the segment in its text: a draw depends on seed and place alone
        drawn = [self._draw(flat[a:b], seed[a:b], start[a:b]) for a, b in ranges(length.tolist())]
        ids, count = (np.concatenate(x) if x else np.zeros(0, "i8") for x in zip(*drawn)) if drawn else (np.zeros(0, "i8"),) * 2
        bounds = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        ids, bounds = self.spell(ids, bounds)
        ids = ids.astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _draw(self, flat: list[str], seed: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a drawn segmentation of each segment, one after another, and how many each has."""
        index = {s: i for i, s in enumerate(dict.fromkeys(flat))}
        lattices = Lattices(self.vocabulary, list(index))
        which = np.fromiter(map(index.__getitem__, flat), "i8", len(flat))
        node, live, steps, keys = lattices.last[which], np.arange(len(flat)), [], lattices.keys()
        count = np.zeros(len(flat), "i8")
        while live.size:
            v = node[live]
            draw = v + uniform(seed[live], start[live] + lattices.place[v])
            edge = lattices.first[v]
            past = np.flatnonzero(keys[edge] <= draw)
            while past.size:
                edge[past] += 1
                past = past[keys[edge[past]] <= draw[past]]
            steps.append((live, lattices.piece[edge]))
            node[live] = lattices.source[edge]
            count[live] += 1
            live = live[node[live] >= 0]
        behind = np.cumsum(count)
        ids = np.zeros(int(count.sum()), "i8")
        for k, (who, piece) in enumerate(steps):
            ids[behind[who] - 1 - k] = piece
        return ids, count

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put byte pieces in the place of characters that are marked by their negated code points."""
        marked = np.flatnonzero(ids <= 0)
        width = np.ones(len(ids), "i8")
        width[marked] = utf8_bytes(-ids[marked])
        ahead = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        for c in np.unique(ids[marked]).tolist():
            at = ahead[marked[ids[marked] == c]]
            for k, b in enumerate(chr(-c).encode("utf-8")):
                out[at + k] = self.byte_ids[b]
        return out, ahead[bounds]


def decode(v: Vocabulary, ids: bytes | None) -> str:
    if not ids:
        return ""
    return b"".join(map(v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


def vocabulary(path: str | None = None) -> Vocabulary:
    """One vocabulary a Python worker."""
    return resident(__name__, ("vocabulary", path), lambda: Vocabulary(path))


def marginals(path: str | None = None, weights: Weights | None = None) -> Marginals:
    """One store a Python worker, so that it outlives a task; one of other weights goes."""
    kept, name = resident(__name__, ("marginals", path), dict), weights.name if weights else None
    if name not in kept:
        kept.clear()
        kept[name] = Marginals(vocabulary(path).weighted(weights) if weights else vocabulary(path))
    return kept[name]
