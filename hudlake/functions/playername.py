"""Player names: scripts of a text, ASCII names by place, and the scoring of recognised candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hudlake.functions import text as T

# Scripts as code-point ranges, words that are no names, and shapes of names.
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}",
    "han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}",
    "latin": "A-Za-z",
}
CJK = SCRIPTS["hangul"] + SCRIPTS["kana"] + SCRIPTS["han"]
NO_NAMES = ["MISSION", "COMPLETE", "TIME", "CLEAR", "PLAYER", "SPLIT", "LEVEL", "EASY", "EXTREME", "HARD", "MEDIUM", "NORMAL", "TOP", "SEC"]
NAME_IN_CORNER = r"\A[A-Z][A-Z0-9_]{2,23}\z"
LONGER_NAME = "[A-Z][A-Z0-9_]{2,24}"
BANNER_NAME = f"({LONGER_NAME}){T.W}+MISSION{T.W}+COMPLETE"
BOARD_NAME = rf"{T.LEFT}({LONGER_NAME})[^{T.WORD}\n][^\n]*?[0-9]{{1,4}}[.,][0-9]{{2}}{T.W}*SEC"
EDGE_MARKS = " :|~!.,*_-"
# Weights of regions, the script expected of a language, and the bonuses of a candidate.
REGION_WEIGHTS = {"BL": 0.20, "BAN": 0.10}
EXPECTED = {"korean": "hangul", "japan": "kana", "ch": "han"}
HANGUL_BONUS, KANA_BONUS, HAN_BONUS = 0.35, 0.30, 0.25
LEAST_HANGUL, LEAST_KANA, LEAST_HAN, MIXED_KANA, MIXED_HAN = 0.50, 0.40, 0.60, 0.20, 0.25
SHARE_WEIGHTS = {"hangul": 0.30, "kana": 0.20, "han": 0.10}
LEAST_CJK = 2
GATE, GATE_KEEPS, LEAST_SCRIPT = 0.40, 0.20, 0.20


def cjk_count(x: Column) -> Column:
    return T.count_in(T.text_or_empty(x), CJK)


def with_scripts(df: DataFrame, text: str, scripts: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each script: its share of the characters of ``text``, white space aside; 0 for none."""
    size = F.length("_dense")
    share = {s: F.when(size > 0, T.count_in(F.col("_dense"), SCRIPTS[s]) / size).otherwise(F.lit(0.0)) for s in scripts or SCRIPTS}
    return T.stepwise(df, {"_dense": T.without_white(F.col(text))}, **share)


def banner_fragment(x: Column) -> Column:
    """The text before MISSION COMPLETE, in single spaces, without marks at either end."""
    x = T.text_or_empty(x)
    head = F.coalesce(F.left(x, F.nullif(F.instr(F.upper(x), "MISSION COMPLETE"), F.lit(0)) - 1), x)
    return T.strip(F.btrim(F.regexp_replace(head, f"{T.W}{{2,}}", " "), F.lit(EDGE_MARKS)))


def named(x: Column) -> Column:
    """The word unless there is none or it is a generic one."""
    return F.when((x != "") & ~x.isin(NO_NAMES), x)


def with_corner_name(df: DataFrame, bottom_left: str, out: str) -> DataFrame:
    """``df`` with the last word at the bottom left, where it has the shape of a name."""
    words = F.split(T.squeezed(F.upper(T.text_or_empty(F.col(bottom_left)))), " ")
    last = F.col("_last")
    return T.stepwise(df, {"_last": F.element_at(words, -1)}, **{out: named(F.when(F.regexp_like(last, F.lit(NAME_IN_CORNER)), last))})


def with_other_name(df: DataFrame, banner: str, top_right: str, out: str) -> DataFrame:
    """``df`` with the word before MISSION COMPLETE, else the first word before a time on the board; first matches only."""
    first = lambda c, shape: F.regexp_extract(F.upper(T.text_or_empty(F.col(c))), shape, 1)
    steps = {"_before": first(banner, BANNER_NAME), "_listed": first(top_right, BOARD_NAME)}
    return T.stepwise(df, steps, **{out: F.coalesce(named(F.col("_before")), named(F.col("_listed")))})


def region_weight(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REGION_WEIGHTS.items() for x in kv])[label], F.lit(0.0))


def expected_script(language: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])[language], F.lit("latin"))


def candidate_score(confidence: Column, language: Column, label: Column, shares: dict[str, Column]) -> Column:
    """Recognition confidence plus what the candidate's script and region are worth."""
    script, hangul, kana, han = expected_script(language), shares["hangul"], shares["kana"], shares["han"]
    zero = F.lit(0.0)
    bonus = F.when((script == "hangul") & (hangul >= LEAST_HANGUL), HANGUL_BONUS).otherwise(zero)
    bonus += F.when((script == "kana") & ((kana >= LEAST_KANA) | ((han >= MIXED_HAN) & (kana >= MIXED_KANA))), KANA_BONUS).otherwise(zero)
    bonus += F.when((script == "han") & (han >= LEAST_HAN), HAN_BONUS).otherwise(zero)
    bonus += SHARE_WEIGHTS["hangul"] * hangul + SHARE_WEIGHTS["kana"] * kana + SHARE_WEIGHTS["han"] * han
    return confidence + (bonus + region_weight(label))


def preferred_name(corner: Column, cjk_corner: Column, other: Column, cjk_all: Column, legacy: bool = False) -> Column:
    """The corner's ASCII name; without one the corner's CJK name; then the other ASCII and CJK names.

    ``legacy`` takes the CJK name of all regions before the other ASCII name.
    """
    real = lambda x: F.when(cjk_count(x) >= LEAST_CJK, x)
    last = [real(cjk_all), other] if legacy else [other, real(cjk_all)]
    return F.coalesce(corner, real(cjk_corner), *last)
