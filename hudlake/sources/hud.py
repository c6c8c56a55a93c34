"""Screen texts derived from the star-schema tables, in SQL that Spark and DuckDB read alike.

``{orders}`` stands for the orders table. Noise goes by the order key's remainder, so that each form of
keyword, number and name occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hudlake.sources.tables import table

SCREENS = """
SELECT image_id, k,
  CASE WHEN k = 0 THEN 'MAP CODE: ' || code WHEN k = 1 THEN 'MAPC0DE ' || code WHEN k = 2 THEN 'map  lode-' || code
       WHEN k = 3 THEN 'MAP BY KUMA CODE ' || code WHEN k = 4 THEN 'MAP CODE' WHEN k = 5 THEN 'LEVEL 3 ' || code || ' FLOOR'
       WHEN k = 6 THEN 'MAP CODE: MADE BY X' WHEN k = 7 THEN 'MAP ' || code || '가' WHEN k = 8 THEN 'SPLIT TIME' ELSE code || ' MAP CDE:BH0P' END AS top_left,
  CASE WHEN k % 3 = 0 THEN 'MAP CODE' WHEN k = 4 THEN '12,34 SEC ' || code WHEN k = 10 THEN secs || 'SEC' ELSE '' END AS top_left_white,
  CASE WHEN k % 4 = 0 THEN code ELSE 'level' END AS top_left_cyan,
  CASE WHEN k = 0 THEN 'MISSION COMPLETE TIME ' || secs || ' SEC' WHEN k = 1 THEN name || ' MISSION  COMPLETE T1ME ' || translate(secs, '0158', 'OISB') || ' 5EC'
       WHEN k = 2 THEN 'TIME ' || substr(secs, 1, 1) || ' ' || substr(secs, 2) || ' SEC' WHEN k = 3 THEN 'TIME MISSION COMPLETE ' || secs || ' SEC'
       WHEN k = 4 THEN '99.99 FOO ' || secs || ' SEC' WHEN k = 5 THEN '' WHEN k = 6 THEN '가나' || name || ' MISSION COMPLETE!' WHEN k = 7 THEN 'x' || secs || ' 10.00 20.00'
       WHEN k = 8 THEN 'TOP MISSION COMPLETE' WHEN k = 9 THEN '1,' || secs || '초' ELSE 'the  run ' END AS banner,
  CASE WHEN k = 5 THEN 'TOP 5 ' || name || ' ' || secs || ' SEC' WHEN k = 8 THEN name || ' x 1' || secs || ' SEC' WHEN k = 10 THEN '12345.67 SEC' WHEN k = 11 THEN secs || '  SEC' ELSE name || '_1' END AS top_right,
  CASE WHEN k % 5 = 0 THEN '250 ' || name WHEN k % 5 = 1 THEN name || ' 250' WHEN k % 5 = 2 THEN '100 mission' ELSE '' END AS bottom_left,
  translate(digits, '0123456789', '가나다라마바사아자차') AS hangul, translate(digits, '0123456789', 'あいうえおかきくけこ') AS kana,
  translate(digits, '0123456789', '一二三四五六七八九十') AS han, digits, secs
FROM (
  SELECT cast(o_orderkey AS bigint) AS image_id, cast(o_orderkey % 12 AS int) AS k, upper(substr(md5(cast(o_orderkey AS string)), 1, 5)) AS code,
         'C' || cast(o_custkey AS string) || 'AB' AS name, substr('00' || cast(o_orderkey * 7919 AS string), -3) AS digits,
         cast(o_orderkey * 37 % 900 + 3 AS string) || '.' || substr('0' || cast(o_orderkey * 53 % 100 AS string), -2) AS secs
  FROM {orders})
"""

#: Fifteen name candidates of each image: three languages by five crops, two of them with noise.
CANDIDATES = """
SELECT image_id, cast(9 + c.n AS int) AS call_no, cast(0 AS int) AS line_no, cast((image_id * 31 + c.n * 17) % 50 AS double) / 100.0 + 0.5 AS confidence,
  CASE WHEN (image_id + c.n) % 7 = 0 THEN 'ABC' WHEN (image_id + c.n) % 7 = 1 THEN ' ** ' || hangul || '  MISSION COMPLETE'
       WHEN (image_id + c.n) % 7 = 2 AND k > 5 THEN hangul WHEN (image_id + c.n) % 7 = 3 THEN kana || 'x' WHEN (image_id + c.n) % 7 = 4 THEN han || '_'
       WHEN (image_id + c.n) % 7 = 5 THEN substr(han, 1, 1) ELSE '-' || kana || ' ' || han END AS text
FROM ({screens}) s CROSS JOIN (SELECT explode_n AS n FROM ({fifteen})) c
"""


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCREENS.replace("{orders}", "{o}"), o=table(spark, sf_dir, "orders"))


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = CANDIDATES.format(screens=SCREENS.replace("{orders}", "{o}"), fifteen="SELECT cast(id AS int) AS explode_n FROM range(15)")
    return spark.sql(sql, o=table(spark, sf_dir, "orders"))


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region texts as recognised lines, one line a call, as if each text came from its region's first call."""
    texts = {"banner": 0, "top_right": 3, "bottom_left": 4, "top_left": 5, "top_left_white": 7, "top_left_cyan": 8}
    stack = ", ".join(f"{call}, {name}" for name, call in texts.items())
    return screens(spark, sf_dir).selectExpr("image_id", f"stack({len(texts)}, {stack}) AS (call_no, text)").where("text != ''").selectExpr(
        "image_id", "call_no", "0 AS line_no", "text", "0.9D AS confidence"
    )


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region texts as lines of one word each, dealt in order over all calls that read the region."""
    calls = {"banner": [0, 1, 2], "top_right": [3], "bottom_left": [4], "top_left": [5, 6], "top_left_white": [7], "top_left_cyan": [8]}
    first = ", ".join(f"{c[0]}, {len(c)}, {name}" for name, c in calls.items())
    words = screens(spark, sf_dir).selectExpr("image_id", f"stack({len(calls)}, {first}) AS (first, calls, text)").selectExpr(
        "image_id", "first", "calls", "posexplode(filter(split(text, ' '), w -> w != '')) AS (n, text)"
    )
    return words.selectExpr("image_id", "first + least(n, calls - 1) AS call_no", "n AS line_no", "text", "0.9D AS confidence")
