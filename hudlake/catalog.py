"""Named queries over the star-schema tables and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake import oracles as O
from hudlake.functions import clock, mapcode
from hudlake.functions import playername as N
from hudlake.functions import text as T
from hudlake.operators import images, ocr
from hudlake.plans import extract, requests
from hudlake.schema import TEXTS, call_plan
from hudlake.sources import hud, inputs
from hudlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


NUMBER = "translate(cast(cast(floor(l_extendedprice) AS bigint) AS string), '0158', 'OISB') || CASE WHEN l_linenumber % 2 = 0 THEN ',' ELSE '.' END || cast(l_linenumber AS string) || '5 x'"


@query("loose_number", f"SELECT l_orderkey, l_linenumber, {O.loose(NUMBER)} AS value FROM lineitem")
def loose_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clock.loose_number(F.expr(NUMBER)).alias("value"))


def _banner(legacy):
    return lambda spark, sf_dir: clock.with_banner_seconds(hud.screens(spark, sf_dir).select("image_id", "banner"), "banner", "seconds", legacy).drop("banner")


query("banner_time", O.banner_time(False))(_banner(False))
query("banner_time_legacy", O.banner_time(True))(_banner(True))


@query("time_fallback", f"SELECT image_id, {O.corner('top_right')} AS top_right_seconds, coalesce({O.corner('top_right')}, {O.corner('top_left_white')}) AS seconds FROM ({O.SCREENS})")
def time_fallback(spark, sf_dir):
    right, white = clock.corner_seconds(F.col("top_right")), clock.corner_seconds(F.col("top_left_white"))
    return hud.screens(spark, sf_dir).select("image_id", right.alias("top_right_seconds"), F.coalesce(right, white).alias("seconds"))


def _code(legacy):
    texts = ["top_left", "top_left_white", "top_left_cyan"]
    return lambda spark, sf_dir: mapcode.with_code(hud.screens(spark, sf_dir).select("image_id", *texts), texts, "code", legacy).select("image_id", "code")


query("map_code", O.map_code(False))(_code(False))
query("map_code_legacy", O.map_code(True))(_code(True))

PLAIN_UPPER = "replace(replace(text, 'ß', 'SS'), 'ﬁ', 'FI')"


@query("code_scan_documents", f"WITH {O.code_ctes(f'SELECT doc_id AS id, {PLAIN_UPPER} AS x FROM documents')} SELECT id AS doc_id, code FROM codes")
def code_scan_documents(spark, sf_dir):
    return mapcode.with_code(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "code").select("doc_id", "code")


CORNER_TEXT = "CASE WHEN c_custkey % 3 = 0 THEN c_name || ' ' || 'time' WHEN c_custkey % 3 = 1 THEN '250  ' || replace(c_name, '#', '') ELSE replace(c_name, '#', '_') || ' ' END"


@query("ascii_name_bl", f"SELECT c_custkey, {O.corner_name(CORNER_TEXT)} AS name FROM customer")
def ascii_name_bl(spark, sf_dir):
    return N.with_corner_name(table(spark, sf_dir, "customer").select("c_custkey", F.expr(CORNER_TEXT).alias("corner")), "corner", "name").drop("corner")


BOARD_TEXT = "CASE WHEN s_suppkey % 2 = 0 THEN 'TOP 5 ' ELSE '' END || replace(s_name, '#', '') || ' ' || cast(s_suppkey AS string) || '.25 SEC'"
BANNER_TEXT = "CASE WHEN s_suppkey % 3 = 0 THEN '9' || replace(s_name, '#', '_') || ' mission  complete' ELSE 'MISSION COMPLETE' END"


@query("ascii_name_banner", f"SELECT s_suppkey, {O.other_name(BANNER_TEXT, BOARD_TEXT)} AS name FROM supplier")
def ascii_name_banner(spark, sf_dir):
    texts = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(BANNER_TEXT).alias("banner"), F.expr(BOARD_TEXT).alias("board"))
    return N.with_other_name(texts, "banner", "board", "name").select("s_suppkey", "name")


_PROFILE = ", ".join(f"{O.share('text', s)} AS {s}" for s in O.SCRIPTS)


@query("script_profile", f"SELECT key, {_PROFILE}, {O.count('text', O.CJK)} AS cjk FROM (SELECT doc_id AS key, text FROM documents UNION ALL SELECT -1 - image_id, han || kana || ' ' || hangul || digits FROM ({O.SCREENS}))")
def script_profile(spark, sf_dir):
    made = hud.screens(spark, sf_dir).selectExpr("-1 - image_id AS key", "han || kana || ' ' || hangul || digits AS text")
    both = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text").union(made)
    return N.with_scripts(both, "text").select("key", *N.SCRIPTS, N.cjk_count(F.col("text")).cast("long").alias("cjk"))


_FRAGMENTS = "SELECT conv_id * 1000 + turn AS key, '** ' || replace(text, '. ', '.   ') || ' :|~' AS text FROM conversations"


@query("banner_fragment", f"SELECT key, {O.fragment('text')} AS fragment FROM ({_FRAGMENTS} UNION ALL SELECT -1 - image_id, banner FROM ({O.SCREENS}))")
def banner_fragment(spark, sf_dir):
    said = spark.sql(_FRAGMENTS.replace("conversations", "{c}"), c=table(spark, sf_dir, "conversations"))
    both = said.union(hud.screens(spark, sf_dir).selectExpr("-1 - image_id", "banner"))
    return both.select("key", N.banner_fragment(F.col("text")).alias("fragment"))


def _candidates(spark, sf_dir, profile="current"):
    return ocr.candidates(hud.candidate_lines(spark, sf_dir), profile)


@query("hangul_gate", f"WITH {O.score_ctes()} SELECT image_id, call_no, line_no, language_code FROM pool_gate WHERE NOT g OR hangul >= 0.20 OR language_code = 'korean'")
def hangul_gate(spark, sf_dir):
    return extract.gated(_candidates(spark, sf_dir)).select("image_id", "call_no", "line_no", "language_code")


@query("name_candidates_scored", f"WITH {O.score_ctes()} SELECT image_id, call_no, line_no, text, language_code, roi_label, round(score, 6) AS score FROM pool")
def name_candidates_scored(spark, sf_dir):
    return extract.scored(_candidates(spark, sf_dir)).select("image_id", "call_no", "line_no", "text", "language_code", "roi_label", F.round("score", 6).alias("score"))


@query("best_name", f"WITH {O.score_ctes()} SELECT image_id, text AS name FROM pool_best")
def best_name(spark, sf_dir):
    return extract.best_names(_candidates(spark, sf_dir))


def _priority(profile):
    def run(spark, sf_dir):
        texts = hud.screens(spark, sf_dir).select("image_id", *TEXTS)
        return extract.records(texts, extract.cjk_names(_candidates(spark, sf_dir, profile)), profile).select("image_id", "name")

    return run


for _profile in ("current", "legacy"):
    query("name_priority" + "_legacy" * (_profile == "legacy"), f"WITH {O.name_priority(_profile == 'legacy')} SELECT image_id, name FROM names")(_priority(_profile))


@query("region_texts", f"SELECT conv_id, {O.strip("string_agg(text, ' ' ORDER BY turn, text)")} AS text FROM conversations GROUP BY conv_id")
def region_texts(spark, sf_dir):
    return extract.joined_lines(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query("region_texts_by_call", O.REGION_WORDS)
def region_texts_by_call(spark, sf_dir):
    """Every region is read by all its calls, and each call reads several lines."""
    return extract.region_texts(hud.word_lines(spark, sf_dir))


_SIZES = "SELECT o_orderkey AS image_id, cast(640 + o_orderkey % 1301 AS int) AS width, cast(360 + o_orderkey % 733 AS int) AS height FROM orders"
_SPEC = ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, *v in O.REGIONS)
_BOUNDS = ", ".join(
    f"CAST(greatest(0, least({size}, trunc({size} * {c}))) AS INT) AS b{c}" for size, c in (("width", "x1"), ("height", "y1"), ("width", "x2"), ("height", "y2"))
)


@query("roi_bounds", f"SELECT image_id, roi, {_BOUNDS} FROM ({_SIZES}) i CROSS JOIN (VALUES {_SPEC}) r(roi, x1, y1, x2, y2)")
def roi_bounds(spark, sf_dir):
    found = images.crop_bounds(spark.sql(_SIZES.replace("orders", "{o}"), o=table(spark, sf_dir, "orders")))
    return found.select("image_id", "roi", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])


_PLAN = "SELECT image_id, cast(range AS int) AS call_no, CASE WHEN range < 9 THEN 'en' WHEN range < 14 THEN 'ch' WHEN range < 19 THEN 'korean' ELSE 'japan' END AS language_code, CASE WHEN range < 9 THEN NULL WHEN (range - 9) % 5 < 2 THEN 'BL' ELSE 'BAN' END AS roi_label"


@query("ocr_plan_fanout", f"{_PLAN} FROM (SELECT o_orderkey AS image_id FROM orders) CROSS JOIN range(24)")
def ocr_plan_fanout(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return found.crossJoin(F.broadcast(call_plan(spark))).select("image_id", "call_no", "language_code", "roi_label")


@query("base64_normalise", "SELECT doc_id, b AS padded, CAST(octet_length(from_base64(b)) AS INT) AS n_bytes FROM (SELECT doc_id, rpad(p, CAST(ceil(length(p) / 4.0) * 4 AS INT), '=') AS b FROM (SELECT doc_id, rtrim(to_base64(encode(source || lang)), '=') AS p FROM documents))")
def base64_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "b", F.translate(F.concat(F.lit(" "), F.rtrim(F.translate(F.base64(F.concat("source", "lang").cast("binary")), "=", " ")), F.lit("\n")), "+/", "-_")
    )
    padded = inputs.padded_base64(F.col("b"))
    return docs.select("doc_id", padded.alias("padded"), F.length(F.try_to_binary(padded, F.lit("base64"))).alias("n_bytes"))


@query("base64_lenient", O.BASE64_LENIENT)
def base64_lenient(spark, sf_dir):
    plain = F.rtrim(F.translate(F.base64(F.concat("source", "lang", "doc_id").cast("binary")), "=", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("p"))
    texts = docs.withColumn("pad", F.expr("repeat('=', cast((4 - length(p) % 4) % 4 AS int))")).select("doc_id", F.expr(SPOILT).alias("image_b64"))
    return inputs.decoded(texts).select("doc_id", "status", F.when(F.col("status") == 200, F.hex("bytes")).alias("bytes"))


#: Base64 texts spoilt in ten ways: foreign characters, padding in odd places, none, too much, an address, a letter that is not ASCII.
SPOILT = """CASE doc_id % 10 WHEN 0 THEN p || pad WHEN 1 THEN substr(p, 1, 3) || '*~' || substr(p, 4) WHEN 2 THEN substr(p, 1, 6) || '=' || substr(p, 7) || pad
  WHEN 3 THEN substr(p, 1, 6) || '==' || substr(p, 7) WHEN 4 THEN p || pad || p WHEN 5 THEN substr(p, 1, length(p) - 1) WHEN 6 THEN ' =' || p || pad
  WHEN 7 THEN 'data:image/png;base64,' || p || pad WHEN 8 THEN p || 'é' ELSE '' END"""


def _lines(spark, sf_dir):
    return hud.region_lines(spark, sf_dir).union(hud.candidate_lines(spark, sf_dir).select("image_id", "call_no", "line_no", "text", "confidence"))


def _flat(df):
    return df.select("image_id", "name", "time", "code", *[F.col(f"texts.{t}").alias(t) for t in TEXTS])


@query("extract_record", O.record())
def extract_record(spark, sf_dir):
    return _flat(extract.extract(_lines(spark, sf_dir)))


@query("extract_record_legacy", O.record(True).replace(O.LANG, O.LANG_LEGACY))
def extract_record_legacy(spark, sf_dir):
    return _flat(extract.extract(_lines(spark, sf_dir), "legacy"))


@query("extract_json", O.json(O.record()))
def extract_json(spark, sf_dir):
    return extract.as_json(extract.extract(_lines(spark, sf_dir)))


def _pictures(spark, sf_dir, side=8):
    """Small images: a pattern of each supplier key's digest, ``side`` by ``side`` pixels of three channels."""
    data = F.unhex(F.concat(*[F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(f"/{i}"))) for i in range(3 * side * side // 16)]))
    size = [F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("channels")]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), *size, data.alias("data"))


def _kernel(kernel):
    def run(spark, sf_dir):
        import numpy as np
        import pandas as pd

        def count(batches):
            for b in batches:
                lit = [int((kernel(np.frombuffer(d, "u1").reshape(h, w, c)) > 0).sum()) for h, w, c, d in zip(b.height, b.width, b.channels, b.data)]
                yield pd.DataFrame({"image_id": b.image_id, "lit": lit})

        return _pictures(spark, sf_dir).mapInPandas(count, "image_id long, lit long")

    return run


query("white_mask", O.WHITE_MASK)(_kernel(images.white_mask))
query("cyan_mask", O.CYAN_MASK)(_kernel(images.cyan_mask))


@query("clahe_binary", O.contrast_binary())
def clahe_binary(spark, sf_dir):
    import numpy as np

    def run(batches):
        import pandas as pd

        for b in batches:
            hits = [np.flatnonzero(images.VARIANTS["binary"](np.frombuffer(d, "u1").reshape(h, w, c))) for h, w, c, d in zip(b.height, b.width, b.channels, b.data)]
            yield pd.DataFrame({"image_id": b.image_id, "lit": [len(x) for x in hits], "marks": [int((x + 1).sum()) for x in hits]})

    return _pictures(spark, sf_dir, 16).mapInPandas(run, "image_id long, lit long, marks long")


def size_engine(language: str):
    """An engine for trials: it reads the size of a crop, an empty line and one of unknown confidence, in a recogniser's shape."""
    box = [[0, 0], [1, 0], [1, 1], [0, 1]]
    return lambda image, lang: [[[box, (f"{lang} {image.shape[1]}x{image.shape[0]}", 0.5)], [box, ("", 1.0)], [box, ("last", None)], [box], "?"]]


@query("ocr_adapter", O.OCR_ADAPTER)
def ocr_adapter(spark, sf_dir):
    return ocr.recognise(images.crops(_pictures(spark, sf_dir)), size_engine)


@query("image_extraction", O.image_extraction())
def image_extraction(spark, sf_dir):
    return extract.as_json(extract.extract_images(_pictures(spark, sf_dir), size_engine))


#: Header of an 8 by 8 bitmap file of 24 bits a pixel, first row on top.
BITMAP = "424DF600000000000000360000002800000008000000F8FFFFFF0100180000000000C000000000000000000000000000000000000000"


def partial_engine(language: str):
    if language == "korean":
        raise OSError("no model")
    return size_engine(language)


@query("answers_by_profile", O.answers(O.image_extraction()))
def answers_by_profile(spark, sf_dir):
    """Requests that hold bitmaps as base64 texts, three of five spoilt, with all engines and without one."""
    coded = F.base64(F.concat(F.unhex(F.lit(BITMAP)), "data"))
    spoilt = [(1, F.concat(F.lit("data:image/bmp;base64,*"), coded)), (2, F.lit("***")), (3, F.lit("Zm9v")), (4, F.lit(None).cast("string"))]
    text = coded
    for k, other in spoilt:
        text = F.when(F.col("image_id") % 5 == k, other).otherwise(text)
    rows = _pictures(spark, sf_dir).select("image_id", text.alias("image_b64"))
    runs = [("current", "current", size_engine), ("current, no korean", "current", partial_engine), ("legacy, no korean", "legacy", partial_engine)]
    out = None
    for name, profile, factory in runs:
        one = requests.answers(rows, factory, profile).select("image_id", F.lit(name).alias("profile"), "status", "json")
        out = one if out is None else out.union(one)
    return out
