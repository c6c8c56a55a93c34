"""Byte-level BPE token ids, where the encoder runs once per distinct pre-token.

The vocabulary's pre-tokenizer cuts a text by the published byte-level BPE pattern. Over the alphabet
below (Latin letters, ASCII digits, common marks and white space) the same pattern is applied here
with every class written out, and the ids of each distinct pre-token are remembered in a bounded
dictionary; pre-tokens repeat far more often than they differ. A text with any other character goes
to the tokenizer whole.

Defined cases: a null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

from hudlake.llm.shared import resident

#: Remembered pre-tokens before the dictionary is emptied (some 60 MB), and the longest of them.
MOST_WORDS, LONGEST_WORD = 250_000, 64
END_ID = 0

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9"
MARKS = "!-/:-@\\[-`{-~¡-©«-¬®-±´¶-¸»¿×÷‐-‧₠-₿"
BLANKS = " \\n\\t\\r"
OTHER = re.compile(f"[^{LETTERS}{DIGITS}{MARKS}{BLANKS}]")
PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[{MARKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Words(dict):
    """Ids by pre-token, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letter = tokenizer.model, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        letter, packed = self.letter, self.packed
        if word[1:].isalpha() and word.isascii() and word[0] == " ":  # most words: printable but for the space
            shown = letter[32] + word[1:]
        else:
            shown = "".join([letter[b] for b in word.encode()])
        found = b"".join([packed[t.id] for t in self.model.tokenize(shown)])
        if len(word) <= LONGEST_WORD:
            self[word] = found
        return found


class Encoder:
    """Texts to little-endian unsigned 32-bit ids as bytes, without an end id."""

    def __init__(self, path: str | None = None, most: int | None = None):
        self.most = most or MOST_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.tokenizer.encode_special_tokens = True
        self.words = Words(self.tokenizer)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER.search(text):
            return self.plain(text)
        if len(self.words) > self.most:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, PRETOKEN.findall(text)))


def encoder(path: str | None = None, most: int | None = None) -> Callable[[str | None], bytes]:
    """One encoder a Python worker, so that its dictionary outlives a task, until a stage without an encoder comes."""
    return resident(__name__, (path, most), lambda: Encoder(path, most).encode)
