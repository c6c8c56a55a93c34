"""Run times in seconds, read from banner and corner texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hudlake.functions import text as T

# Letters that stand for digits, misread keywords, and the shapes of numbers.
LOOKALIKES = ("OQDILSBZG,", "000115826.")
KEYWORD_REPAIRS = [("T1ME", "TIME"), ("TLME", "TIME"), ("TI ME", "TIME"), ("5EC", "SEC"), ("SE€", "SEC"), ("SEL", "SEC")]
DIGIT_LIKE = "0-9OQDBZGISL"
LOOSE_RUN = f"[{DIGIT_LIKE},.]{{3,12}}"
SECONDS_WORD = "SEC|초"
NEAR_KEYWORD, NEAR_UNIT = 80, 8
CORNER_TIME = rf"{T.LEFT}([0-9]{{1,4}}[.,][0-9]{{2}}){T.W}*SEC"


def loose_number(token: Column) -> Column:
    """A number of at most five whole digits and two decimals out of digits and their look-alikes."""
    digits = F.regexp_replace(F.translate(F.upper(token), *LOOKALIKES), "[^0-9.]", "")
    return F.regexp_extract(digits, r"[0-9]{1,5}\.[0-9]{2}", 0).try_cast("double")


def with_banner_seconds(df: DataFrame, banner: str, out: str, legacy: bool = False) -> DataFrame:
    """``df`` with the seconds in a banner: the first number-like run behind TIME, else the best-placed run anywhere.

    Places are scored: 2 within ``NEAR_KEYWORD`` characters behind TIME, 1 with a unit right behind;
    the first of equal scores wins. Profile ``legacy`` does not rejoin digits that a space has split.
    """
    window = T.from_keyword(F.col("_whole"), "TIME", NEAR_KEYWORD)
    if not legacy:
        window = F.regexp_replace(window, rf"([{DIGIT_LIKE}]{{1,5}}){T.W}+([{DIGIT_LIKE}]\.[0-9]{{2}})", "$1$2")
    shape = F.lit(f"(?s)(.*?)({LOOSE_RUN})")
    return T.stepwise(
        df,
        {"_whole": T.squeezed(T.replace_all(F.upper(banner), KEYWORD_REPAIRS))},
        {"_direct": loose_number(F.regexp_extract(window, LOOSE_RUN, 0))},
        {"_rest": F.when(F.col("_direct").isNull(), F.col("_whole"))},  # other rows need no scan
        {"_segments": F.regexp_extract_all("_rest", shape, F.lit(0)), "_runs": F.regexp_extract_all("_rest", shape, F.lit(2))},
        {"_parts": F.arrays_zip("_segments", "_runs")},
        **{out: F.coalesce(F.col("_direct"), _best_run(F.col("_whole"), F.col("_parts")))},
    )


def _best_run(whole: Column, parts: Column) -> Column:
    """Runs are met left to right; a run's end is the summed length of the segments up to it."""
    keyword = F.instr(whole, "TIME")

    def step(acc: Column, part: Column) -> Column:
        end = acc["end"] + F.length(part["_segments"])
        past = end - F.length(part["_runs"]) - (keyword - 1)
        near = F.when((keyword > 0) & past.between(0, NEAR_KEYWORD), 2).otherwise(0)
        unit = F.regexp_like(F.substring(whole, end + 1, F.lit(NEAR_UNIT)), F.lit(SECONDS_WORD)).cast("int")
        value, score = loose_number(part["_runs"]), near + unit
        better = (score > acc["score"]) & value.isNotNull()
        return F.struct(
            end.alias("end"), F.when(better, score).otherwise(acc["score"]).alias("score"), F.when(better, value).otherwise(acc["value"]).alias("value")
        )

    start = F.struct(F.lit(0).alias("end"), F.lit(-1).alias("score"), F.lit(None).cast("double").alias("value"))
    return F.aggregate(parts, start, step)["value"]


def corner_seconds(corner: Column) -> Column:
    """The first number with two decimals that SEC follows."""
    return F.replace(F.regexp_extract(F.upper(corner), CORNER_TIME, 1), F.lit(","), F.lit(".")).try_cast("double")


def with_run_seconds(df: DataFrame, banner: str, top_right: str, top_left_white: str, out: str, legacy: bool = False) -> DataFrame:
    """Banner first, then the top-right corner, then (not in ``legacy``) the white-masked top-left one."""
    fallbacks = [corner_seconds(F.col(c)) for c in ([top_right] if legacy else [top_right, top_left_white])]
    return T.stepwise(with_banner_seconds(df, banner, "_seconds", legacy), **{out: F.coalesce(F.col("_seconds"), *fallbacks)}).drop("_seconds")
