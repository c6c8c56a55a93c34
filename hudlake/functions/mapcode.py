"""Map codes of four to six letters and digits, read from the top-left texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hudlake.functions import text as T

# Words that are no codes, the shapes of the keyword and of a code, and the window.
NO_CODES = ["MADE", "BY", "TIME", "SEC", "SPLIT", "LEVEL", "TOP", "PLAYTEST"]
KEYWORD_CODES = ["CODE", "C0DE"]
GAME_WORDS = ["BH0P", "BHOP"]
TOKEN = "[A-Z0-9]{4,6}"
KEYWORD = "C[O0]?DE"
MISREAD_KEYWORD = f"MAP{T.W}*[CLO0][O0D]{{2}}E"
LEGACY_KEYWORDS = ["MAPCODE", "MAPC0DE", f"MAP{T.W}+C0DE", f"MAP{T.W}+COOE", f"MAP{T.W}+LODE", f"MAP{T.W}+L0DE"]
WINDOW = 80

AFTER_KEYWORD = rf"{KEYWORD}{T.W}*[:\-]?{T.W}*({TOKEN}){T.RIGHT}"
WORD_TOKEN = f"{T.LEFT}{TOKEN}{T.RIGHT}"


def stop_words(legacy: bool) -> list[str]:
    return NO_CODES if legacy else NO_CODES + KEYWORD_CODES + GAME_WORDS


def cleaned(raw: Column) -> Column:
    return F.regexp_replace(F.replace(F.upper(raw), F.lit("O"), F.lit("0")), "[^A-Z0-9]", "")


def map_code(raw: Column, legacy: bool = False) -> Column:
    """A code out of a raw token: O read as 0, four to six characters, at least one digit, no stop word."""
    code = cleaned(raw)
    good = F.length(code).between(4, 6) & F.regexp_like(code, F.lit("[0-9]"))
    return F.when(good if legacy else good & ~raw.isin(stop_words(legacy)), code)


def code_token(legacy: bool) -> str:
    """Pattern of a word that ``map_code`` reads as a code, over text in capitals: a token with a digit or an O, no stop word."""
    return f"{T.LEFT}(?=[A-Z]*[0-9O])(?!(?:{'|'.join(stop_words(legacy))}){T.RIGHT}){TOKEN}{T.RIGHT}"


def with_code(df: DataFrame, texts: list[str], out: str, legacy: bool = False) -> DataFrame:
    """``df`` with the first of: the token behind MAP CODE, the one behind CODE near MAP, the first token near MAP, and
    any token in order, that is a code. In the current profile the first needs no digit.

    The scan for any token is one pattern that stops at its first hit, and runs only where the others found nothing.
    """
    repaired = F.col("_said")
    for shape in LEGACY_KEYWORDS if legacy else [MISREAD_KEYWORD]:
        repaired = F.regexp_replace(repaired, shape, "MAP CODE")
    explicit = map_code(F.col("_explicit"), True) if legacy else F.when(
        (F.col("_explicit") != "") & ~cleaned(F.col("_explicit")).isin(KEYWORD_CODES), cleaned(F.col("_explicit"))
    )
    found = F.coalesce(explicit, map_code(F.col("_behind"), legacy), map_code(F.col("_close"), legacy))
    any_token = F.replace(F.regexp_extract("_whole", code_token(legacy), 0), F.lit("O"), F.lit("0"))
    return T.stepwise(
        df,
        {"_said": F.upper(F.concat_ws(" ", *[T.text_or_empty(F.col(t)) for t in texts]))},
        {"_whole": F.when(F.contains("_said", F.lit("MAP")), repaired).otherwise(F.col("_said"))},
        {"_near": T.from_keyword(F.col("_whole"), "MAP", WINDOW)},
        {
            "_explicit": F.when(F.col("_near").isNotNull(), F.regexp_extract("_whole", rf"MAP{T.W}*{AFTER_KEYWORD}", 1)),
            "_behind": F.regexp_extract("_near", AFTER_KEYWORD, 1), "_close": F.regexp_extract("_near", WORD_TOKEN, 0),
        },
        {"_found": found},
        {"_code": F.when(F.col("_found").isNotNull(), F.col("_found")).otherwise(any_token)},
        **{out: F.when(F.col("_code") != "", F.col("_code"))},
    )
