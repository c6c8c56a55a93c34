"""Text columns: white space, splitting into word tokens, and counting by character class.

Spark's ``\\s``, ``\\d`` and ``\\b`` follow the JVM; here every class is written out, so that results do
not depend on it. Digits are ASCII; full-width digits are not read as numbers.

A text that several expressions read is a column of its own (``with_...`` functions add such columns in
chained projections and drop them again): Catalyst keeps apart what is costly and used twice, so each
normalised text is made once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Unicode lists it, with the four separators 1C-1F.
WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
W = f"[{WHITE}]"
WORD = r"\p{L}\p{N}_"
NOT_WORD = f"[^{WORD}]"
#: Left and right edge of a word.
LEFT, RIGHT = f"(?<![{WORD}])", f"(?![{WORD}])"


def stepwise(df: DataFrame, *steps: dict[str, Column], **out: Column) -> DataFrame:
    """``df`` with the columns ``out``, worked out over the columns of ``steps``, each a projection over the one before."""
    keep = df.columns
    for step in steps:
        if clash := set(step) & set(keep):
            raise ValueError(f"columns {sorted(clash)} stand in the way of working columns; rename them first")
        df = df.withColumns(step)
    return df.select(*[c for c in keep if c not in out], *[v.alias(k) for k, v in out.items()])


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squeezed(x: Column) -> Column:
    """White-space runs as single spaces, none at either end."""
    return F.trim(F.regexp_replace(x, f"{W}+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{W}+|{W}+\z", "")


def without_white(x: Column) -> Column:
    return F.regexp_replace(text_or_empty(x), f"{W}+", "")


def count_in(x: Column, characters: str) -> Column:
    """How many characters of ``x`` belong to the class; whole runs of them are taken out at a time."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{characters}]+", ""))


def from_keyword(x: Column, keyword: str, length: int) -> Column:
    """The ``length`` characters from the keyword's first place on, or null."""
    at = F.instr(x, keyword)
    return F.when(at > 0, F.substring(x, at, F.lit(length)))


def replace_all(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x
