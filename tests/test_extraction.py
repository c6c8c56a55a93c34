"""Hand-traced cases of the extraction columns, and the whole record."""

import json

import pytest
from hudlake.functions import clock, mapcode
from hudlake.functions import playername as N
from hudlake.functions import text as T
from hudlake.operators import ocr
from hudlake.plans import extract
from hudlake.schema import OCR_LINES, TEXTS, call_plan
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def staged(spark, values, make, kind="string"):
    """As ``column``, for functions that add a column ``y`` to a table with column ``x``."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in make(rows).orderBy("i").collect()]


TIMES = [
    ("MISSION COMPLETE TIME 123.45 SEC", 123.45, 123.45), ("TIME 1Z3.4S SEC", 123.45, 123.45), ("TIME 12 3.45 SEC", 123.45, 3.45),
    ("TIME MISSION COMPLETE 45.67 SEC", 45.67, 45.67), ("1,234.56 SEC", 1.23, 1.23), ("10.00 20.00", 10.0, 10.0), ("99.99 FOO 12.34 SEC", 12.34, 12.34),
    ("t1me 5.25 5ec", 5.25, 5.25), ("", None, None), (None, None, None), ("TIME", None, None), ("12.34초 99.99", 12.34, 12.34),
]


def test_banner_seconds(spark):
    texts = [t for t, _, _ in TIMES]
    assert staged(spark, texts, lambda d: clock.with_banner_seconds(d, "x", "y")) == [a for _, a, _ in TIMES]
    assert staged(spark, texts, lambda d: clock.with_banner_seconds(d, "x", "y", True)) == [b for _, _, b in TIMES]


def test_corner_seconds(spark):
    assert column(spark, ["1234,56SEC", "12345.67 SEC", "x 1.23 SEC 4.56 SEC", "a1.23SEC", None], clock.corner_seconds) == [1234.56, None, 1.23, None, None]


def test_loose_number(spark):
    got = column(spark, ["O1.2S", "123456.78", "1.2", "B8,00", "", None], clock.loose_number)
    assert got == [1.25, 23456.78, None, 88.0, None, None]


CODES = [
    ("MAP CODE: A1B2C3", "A1B2C3", "A1B2C3"), ("MAPC0DE KUMA", "KUMA", "C0DE"), ("MAP CODE", None, "C0DE"), ("MAP CODE: MADE BY X", "MADE", "C0DE"),
    ("FLOOR 12", "FL00R", "FL00R"), ("MAP BY KUMA CODE X9Y8Z", "X9Y8Z", "X9Y8Z"), ("", None, None), ("TIME LEVEL", None, None),
]


def test_map_codes(spark):
    for legacy in (False, True):
        none = lambda d: d.withColumns({"blank": F.lit(""), "none": F.lit(None).cast("string")})
        got = staged(spark, [c[0] for c in CODES], lambda d: mapcode.with_code(none(d), ["x", "blank", "none"], "y", legacy))
        assert got == [c[1 + legacy] for c in CODES]


def test_code_tokens_are_what_the_normaliser_takes(spark):
    """The pattern of a token in one step agrees with splitting, the list of stop words and ``map_code``."""
    words = ["A1B2", "ABCD", "FLOOR", "TIME", "B0HP", "BH0P", "BHOP", "CODE", "C0DE", "CODEX", "1234567", "12", "é1234", "LEVEL", "MADE1", "_ABC1"]
    for legacy in (False, True):
        one = column(spark, words, lambda x: F.regexp_extract(x, mapcode.code_token(legacy), 0))
        two = column(spark, words, lambda x: F.when(F.regexp_like(x, F.lit(r"\A[A-Z0-9]{4,6}\z")) & ~x.isin(mapcode.stop_words(legacy)), mapcode.map_code(x, legacy)))
        assert [w if w in words and x else "" for w, x in zip(one, one)] == [w if x else "" for w, x in zip(words, two)]


def test_names(spark):
    corners = ["250 DAHMX", "DAHMX 250", "MISSION", "a  b_c9 ", "", None, "x ab"]
    assert staged(spark, corners, lambda d: N.with_corner_name(d, "x", "y")) == ["DAHMX", None, None, "B_C9", None, None, None]
    none = lambda d: d.withColumn("none", F.lit(None).cast("string"))
    assert staged(spark, ["9ARROW MISSION  COMPLETE", "TOP MISSION COMPLETE", None], lambda d: N.with_other_name(none(d), "x", "none", "y")) == ["ARROW", None, None]
    assert staged(spark, ["TOP 5 ARROW 12.34 SEC", "ARROW x 112.34SEC", "ARROW\n12.34 SEC"], lambda d: N.with_other_name(none(d), "none", "x", "y")) == [None, "ARROW", None]
    with pytest.raises(ValueError):
        N.with_corner_name(none(spark.createDataFrame([("a", "b")], "x string, _last string")), "x", "y")
    assert column(spark, ["가나다 MISSION COMPLETE!", " **a   b|~ ", None, "가　　나"], N.banner_fragment) == ["가나다", "a b", "", "가 나"]


def test_scores_and_ties(spark):
    rows = [(1, 0, "가나", 0.90, "korean", "BL"), (2, 0, "一二", 0.95, "ch", "BAN"), (3, 1, "かな", 0.5, "japan", "BL"), (3, 0, "ひら", 0.5, "japan", "BL"), (4, 0, "abc", 1.0, "ch", "BL"), (5, 0, "가나", 0.1, "ch", "BL"), (5, 1, "一二三", 9.0, "ch", "BL")]
    plain = spark.createDataFrame([(i, 9, *r) for i, *r in rows], "image_id long, call_no int, line_no int, text string, confidence double, language_code string, roi_label string")
    c = ocr.with_profile(plain)
    got = {(r.image_id, r.line_no): r.score for r in extract.scored(c).collect()}
    assert abs(got[1, 0] - 1.75) < 1e-9 and abs(got[2, 0] - 1.40) < 1e-9 and (5, 1) not in got and (4, 0) not in got
    assert {r.image_id: r.name for r in extract.best_names(c).collect()} == {1: "가나", 2: "一二", 3: "ひら", 5: "가나"}
    pool = {}
    for r in extract.scored(c).orderBy(F.desc("score"), "call_no", "line_no").collect():
        pool.setdefault(r.image_id, r.text)
    assert pool == {1: "가나", 2: "一二", 3: "ひら", 5: "가나"}


def test_lines_past_any_number_keep_their_order(spark):
    rows = [(1, 5, n, f"w{n}", 0.5) for n in (0, 99_999, 100_000, 250_000)] + [(1, 6, 0, "last", 0.5)]
    assert extract.region_texts(spark.createDataFrame(rows, OCR_LINES)).first().top_left == "w0 w99999 w100000 w250000 last"


EXAMPLE = {"top_left": "MAP CODE: A1B2C3", "top_left_white": "MAP CODE", "top_left_cyan": "A1B2C3", "banner": "MISSION COMPLETE TIME 123.45 SEC", "top_right": "123.45 SEC", "bottom_left": "250 DAHMX"}


def test_whole_record(spark):
    first = {t: c for c, t in reversed([(r.call_no, r.target) for r in call_plan(spark).where("target IS NOT NULL").collect()])}
    rows = [(7, first[t], 0, x, 0.9) for t, x in EXAMPLE.items()] + [(7, 20, 0, "가나다", 0.99), (8, 20, 0, "가나다라마 MISSION COMPLETE", None)]
    out = extract.extract(spark.createDataFrame(rows, OCR_LINES)).orderBy("image_id").collect()
    assert (out[0].name, out[0].time, out[0].code) == ("DAHMX", 123.45, "A1B2C3")
    assert out[0].texts.asDict() == EXAMPLE
    assert (out[1].name, out[1].time, out[1].code) == ("가나다라마", None, None) and set(out[1].texts) == {""}
    shown = json.loads(extract.as_json(extract.extract(spark.createDataFrame(rows, OCR_LINES))).where("image_id = 8").first().json)
    assert shown["extracted"]["time"] is None and list(shown["extracted"]["texts"]) == ["topLeft", "topLeftWhite", "topLeftCyan", "banner", "topRight", "bottomLeft"]


def test_name_order_of_profiles(spark):
    row = spark.range(1)
    pick = lambda *x, legacy=False: row.select(N.preferred_name(*[F.lit(v).cast("string") for v in x], legacy).alias("n")).first().n
    assert pick("A1B", "가나", "XYZ", "다라") == "A1B" and pick(None, "가나", "XYZ", "다라") == "가나"
    assert pick(None, "가", "XYZ", "다라") == "XYZ" and pick(None, None, "XYZ", "다라", legacy=True) == "다라"
    assert pick(None, None, None, "가") is None


def test_scripts(spark):
    assert staged(spark, ["가 나a1", "", None, "é"], lambda d: N.with_scripts(d, "x").withColumnRenamed("hangul", "y")) == [0.5, 0.0, 0.0, 0.0]
    assert column(spark, ["aé", "カな一가x"], N.cjk_count) == [0, 4]
    assert column(spark, ["a　\x1cb  c"], T.without_white) == ["abc"]


def test_camel():
    assert [extract.camel(x) for x in ("top_left_white", "name", "b2c_d2e")] == ["topLeftWhite", "name", "b2cD2E"]


def test_plan_has_24_calls(spark):
    assert call_plan(spark).count() == 24
    order = lambda p: [r.language_code for r in call_plan(spark, p).where("call_no >= 9").orderBy("call_no").collect()][::5]
    assert order("current") == ["ch", "korean", "japan"] and order("legacy") == ["korean", "japan", "ch"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="TIMESC0O1lZ.,:- 25EMAPCODE가", max_size=40), min_size=1, max_size=30))
def test_extractors_never_fail(spark, texts):
    codes = staged(spark, texts, lambda d: mapcode.with_code(d, ["x", "x", "x"], "y"))
    assert all(c is None or (4 <= len(c) <= 6 and c.isascii()) for c in codes)
    assert all(v is None or round(v, 2) == v for v in staged(spark, texts, lambda d: clock.with_banner_seconds(d, "x", "y")))


def test_engine_lines():
    assert ocr.lines_of([("a ", 0.5), ("", 1), ("b", None), ("c", "x"), "bad", (1, 2), ("d",)]) == [("a", 0.5), ("b", -1.0), ("c", -1.0)]
    box = [[0, 0], [9, 0], [9, 5], [0, 5]]
    blocks = [[box, ("a ", 0.5)], [box, ("", 1)], [box, ("b", None)], [box, (None, 1)], [box], [box, "c"], [box, ("d", "x")], None]
    assert ocr.lines_of([blocks]) == ocr.lines_of(blocks) == [("a", 0.5), ("b", -1.0), ("d", -1.0)]
    assert ocr.lines_of([[]]) == ocr.lines_of([None]) == ocr.lines_of(None) == []
    with pytest.raises(RuntimeError):
        ocr.require_engine(["ch"])
