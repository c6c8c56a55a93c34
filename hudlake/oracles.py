"""DuckDB statements of what the catalog's queries return, written relationally and on their own terms.

Nothing that decides a result is imported from the modules that these statements judge: patterns, lists,
weights and the plan of calls are stated here a second time, so that a wrong one shows. Only the screen
texts, which are both sides' input, are shared.
"""

from __future__ import annotations

from hudlake.sources import hud

# Fixed values, as in the survey of the semantics.
W = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
RUN = "[0-9OQDBZGISL,.]{3,12}"
SPLIT_DIGITS = rf"([0-9OQDBZGISL]{{1,5}}){W}+([0-9OQDBZGISL]\.[0-9]{{2}})"
REPAIRS = [("T1ME", "TIME"), ("TLME", "TIME"), ("TI ME", "TIME"), ("5EC", "SEC"), ("SE€", "SEC"), ("SEL", "SEC")]
CORNER_TIME = rf"(?:\A|{NOT_WORD})([0-9]{{1,4}}[.,][0-9]{{2}}){W}*SEC"
CODE = "[A-Z0-9]{4,6}"
AFTER_CODE = rf"(?:CODE|C0DE|CDE){W}*[:\-]?{W}*({CODE})(?:{NOT_WORD}|\z)"
MISREAD = f"MAP{W}*[CLO0][O0D][O0D]E"
MISREAD_LEGACY = ["MAPCODE", "MAPC0DE", f"MAP{W}+C0DE", f"MAP{W}+COOE", f"MAP{W}+LODE", f"MAP{W}+L0DE"]
SCAN_STOP_LEGACY = ["MADE", "BY", "TIME", "SEC", "SPLIT", "LEVEL", "TOP", "PLAYTEST"]
SCAN_STOP = [*SCAN_STOP_LEGACY, "CODE", "C0DE"]
CODE_STOP = [*SCAN_STOP, "BH0P", "BHOP"]
GENERIC = ["MISSION", "COMPLETE", "TIME", "CLEAR", "PLAYER", "SPLIT", "LEVEL", "EASY", "EXTREME", "HARD", "MEDIUM", "NORMAL", "TOP", "SEC"]
CORNER_NAME = r"\A[A-Z][A-Z0-9_]{2,23}\z"
BANNER_NAME = f"([A-Z][A-Z0-9_]{{2,24}}){W}+MISSION{W}+COMPLETE"
BOARD_NAME = rf"(?:\A|{NOT_WORD})([A-Z][A-Z0-9_]{{2,24}})[^\p{{L}}\p{{N}}_\n][^\n]*?[0-9]{{1,4}}[.,][0-9]{{2}}{W}*SEC"
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}", "kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}",
    "han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}", "latin": "A-Za-z",
}
CJK = SCRIPTS["hangul"] + SCRIPTS["kana"] + SCRIPTS["han"]
REGIONS = [
    ("TOPLEFT", 0.010, 0.020, 0.360, 0.300), ("TOPLEFT_WIDE", 0.005, 0.010, 0.420, 0.340), ("BANNER", 0.220, 0.180, 0.780, 0.360),
    ("TOPRIGHT", 0.800, 0.170, 0.985, 0.470), ("BOTTOMLEFT", 0.050, 0.825, 0.330, 0.990), ("NAME", 0.050, 0.800, 0.400, 0.900),
]
TEXTS = {"top_left": "topLeft", "top_left_white": "topLeftWhite", "top_left_cyan": "topLeftCyan", "banner": "banner", "top_right": "topRight", "bottom_left": "bottomLeft"}
ENGLISH = [
    ("BANNER", "banner"), ("BANNER", "banner"), ("BANNER", "banner"), ("TOPRIGHT", "top_right"), ("BOTTOMLEFT", "bottom_left"),
    ("TOPLEFT", "top_left"), ("TOPLEFT_WIDE", "top_left"), ("TOPLEFT_WIDE", "top_left_white"), ("TOPLEFT_WIDE", "top_left_cyan"),
]
NAMES = ["NAME", "BOTTOMLEFT", "BANNER", "BANNER", "BANNER"]

SCREENS = hud.SCREENS.replace("{orders}", "orders")
CANDIDATES = hud.CANDIDATES.format(screens=SCREENS, fifteen="SELECT cast(range AS int) AS explode_n FROM range(15)")


def quoted(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def first(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def strip(x: str) -> str:
    return sub(x, rf"\A{W}+|{W}+\z")


def loose(x: str) -> str:
    letters, digits = "OQDILSBZG,", "000115826."
    return f"CAST({first(sub(f"translate(upper({x}), '{letters}', '{digits}')", '[^0-9.]'), '[0-9]{1,5}[.][0-9]{2}')} AS DOUBLE)"


def corner(x: str) -> str:
    return f"CAST(replace({first(f'upper({x})', CORNER_TIME, 1)}, ',', '.') AS DOUBLE)"


def banner_ctes(source: str, legacy: bool = False) -> str:
    """CTEs ending in ``seconds(id, v)`` over source(id, x)."""
    whole = "upper(x)"
    for old, new in REPAIRS:
        whole = f"replace({whole}, '{old}', '{new}')"
    window = "CASE WHEN instr(t, 'TIME') > 0 THEN substr(t, instr(t, 'TIME'), 80) END"
    if not legacy:
        window = sub(window, SPLIT_DIGITS, r"\1\2")
    run = f"(?s)(.*?)({RUN})"
    return f"""
whole AS (SELECT id, {strip(sub(whole, f'{W}+', ' '))} AS t FROM ({source})),
behind AS (SELECT id, t, instr(t, 'TIME') AS kw, {loose(first(window, RUN))} AS direct FROM whole),
parts AS (SELECT id, t, kw, unnest(regexp_extract_all(t, '{run}', 0)) AS seg, unnest(regexp_extract_all(t, '{run}', 2)) AS run,
          unnest(range(len(regexp_extract_all(t, '{run}', 0)))) AS n FROM behind),
placed AS (SELECT *, sum(length(seg)) OVER (PARTITION BY id ORDER BY n) AS e FROM parts),
rated AS (SELECT id, n, {loose('run')} AS v, CASE WHEN kw > 0 AND e - length(run) - kw + 1 BETWEEN 0 AND 80 THEN 2 ELSE 0 END
          + CASE WHEN regexp_matches(substr(t, CAST(e AS BIGINT) + 1, 8), 'SEC|초') THEN 1 ELSE 0 END AS score FROM placed),
top AS (SELECT id, v FROM rated WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, n) = 1),
seconds AS (SELECT b.id, coalesce(b.direct, top.v) AS v FROM behind b LEFT JOIN top USING (id))"""


def banner_time(legacy: bool) -> str:
    return f"WITH {banner_ctes(f'SELECT image_id AS id, banner AS x FROM ({SCREENS})', legacy)} SELECT id AS image_id, v AS seconds FROM seconds"


def code_of(raw: str, legacy: bool) -> str:
    c = sub(f"replace(upper({raw}), 'O', '0')", "[^A-Z0-9]")
    stop = "" if legacy else f" AND {raw} NOT IN {quoted(CODE_STOP)}"
    return f"CASE WHEN length({c}) BETWEEN 4 AND 6 AND regexp_matches({c}, '[0-9]'){stop} THEN {c} END"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{NOT_WORD}+'), lambda w: regexp_full_match(w, '{CODE}'))"


def code_ctes(source: str, legacy: bool = False) -> str:
    """CTEs ending in ``codes(id, code)`` over source(id, x)."""
    text = "upper(x)"
    for shape in MISREAD_LEGACY if legacy else [MISREAD]:
        text = sub(text, shape, "MAP CODE")
    explicit = "CASE WHEN replace(s, 'O', '0') NOT IN ('CODE', 'C0DE') THEN replace(s, 'O', '0') END" if not legacy else code_of("s", True)
    stop = SCAN_STOP_LEGACY if legacy else SCAN_STOP
    return f"""
coded AS (SELECT id, {text} AS t FROM ({source})),
near AS (SELECT id, t, CASE WHEN instr(t, 'MAP') > 0 THEN substr(t, instr(t, 'MAP'), 80) END AS w, {first('t', f'MAP{W}*{AFTER_CODE}', 1)} AS s FROM coded),
options AS (SELECT id, s, {first('w', AFTER_CODE, 1)} AS a, {tokens('w')}[1] AS b, {tokens('t')} AS every FROM near),
scan AS (SELECT id, {code_of('tok', legacy)} AS code FROM (SELECT id, unnest(every) AS tok, unnest(range(len(every))) AS n FROM options)
         WHERE tok NOT IN {quoted(stop)} AND {code_of('tok', legacy)} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1),
codes AS (SELECT o.id, coalesce({explicit}, {code_of('a', legacy)}, {code_of('b', legacy)}, scan.code) AS code FROM options o LEFT JOIN scan USING (id))"""


CODE_SOURCE = f"SELECT image_id AS id, top_left || ' ' || top_left_white || ' ' || top_left_cyan AS x FROM ({SCREENS})"


def map_code(legacy: bool) -> str:
    return f"WITH {code_ctes(CODE_SOURCE, legacy)} SELECT id AS image_id, code FROM codes"


def no_generic(x: str) -> str:
    return f"CASE WHEN {x} NOT IN {quoted(GENERIC)} THEN {x} END"


def corner_name(x: str) -> str:
    last = f"regexp_split_to_array({strip(sub(f'upper({x})', f'{W}+', ' '))}, ' ')[-1]"
    return f"CASE WHEN regexp_matches({last}, '{CORNER_NAME}') AND {last} NOT IN {quoted(GENERIC)} THEN {last} END"


def other_name(banner: str, board: str) -> str:
    return f"coalesce({no_generic(first(f'upper({banner})', BANNER_NAME, 1))}, {no_generic(first(f'upper({board})', BOARD_NAME, 1))})"


def count(x: str, script: str) -> str:
    return f"len(regexp_extract_all({x}, '[{script}]'))"


def share(x: str, script: str) -> str:
    dense = sub(x, W)
    return f"CASE WHEN length({dense}) > 0 THEN CAST({count(dense, SCRIPTS[script])} AS DOUBLE) / length({dense}) ELSE 0 END"


def fragment(x: str) -> str:
    head = f"CASE WHEN instr(upper({x}), 'MISSION COMPLETE') > 0 THEN left({x}, instr(upper({x}), 'MISSION COMPLETE') - 1) ELSE {x} END"
    return strip(f"trim({sub(head, f'{W}{{2,}}', ' ')}, ' :|~!.,*_-')")


LANG = "CASE WHEN call_no < 14 THEN 'ch' WHEN call_no < 19 THEN 'korean' ELSE 'japan' END"
LANG_LEGACY = "CASE WHEN call_no < 14 THEN 'korean' WHEN call_no < 19 THEN 'japan' ELSE 'ch' END"


def score_ctes(where: str = "true", name: str = "pool", lang: str = LANG) -> str:
    """CTEs ending in ``{name}``: the scored pool of the candidates that satisfy ``where``."""
    return f"""
{name}_all AS (SELECT image_id, call_no, line_no, text, confidence, {lang} AS language_code, CASE WHEN (call_no - 9) % 5 < 2 THEN 'BL' ELSE 'BAN' END AS roi_label,
  {share('text', 'hangul')} AS hangul, {share('text', 'kana')} AS kana, {share('text', 'han')} AS han FROM ({CANDIDATES})),
{name}_gate AS (SELECT *, max(hangul) OVER (PARTITION BY image_id) >= 0.40 AS g FROM {name}_all WHERE {where}),
{name} AS (SELECT image_id, call_no, line_no, {fragment('text')} AS text, language_code, roi_label, confidence
    + ((CASE WHEN language_code = 'korean' AND hangul >= 0.50 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN language_code = 'japan' AND (kana >= 0.40 OR (han >= 0.25 AND kana >= 0.20)) THEN 0.30::DOUBLE ELSE 0 END)
       + (CASE WHEN language_code = 'ch' AND han >= 0.60 THEN 0.25::DOUBLE ELSE 0 END) + (0.30::DOUBLE * hangul + 0.20::DOUBLE * kana + 0.10::DOUBLE * han)
       + (CASE roi_label WHEN 'BL' THEN 0.20::DOUBLE ELSE 0.10::DOUBLE END)) AS score
  FROM {name}_gate WHERE (NOT g OR hangul >= 0.20 OR language_code = 'korean') AND {fragment('text')} <> '' AND greatest(hangul, kana, han) >= 0.20 AND length({sub(fragment('text'), W)}) >= 2),
{name}_best AS (SELECT image_id, text FROM {name} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, call_no, line_no) = 1)"""


def real(x: str) -> str:
    return f"CASE WHEN {count(x, CJK)} >= 2 THEN {x} END"


def name_priority(legacy: bool) -> str:
    lang = LANG_LEGACY if legacy else LANG
    other = other_name("s.banner", "s.top_right")
    tail = f"{real('a.text')}, {other}" if legacy else f"{other}, {real('a.text')}"
    return f"""{score_ctes("roi_label = 'BL'", 'corner', lang)}, {score_ctes('true', 'pool', lang)},
names AS (SELECT s.image_id, coalesce({corner_name('s.bottom_left')}, {real('c.text')}, {tail}) AS name
  FROM ({SCREENS}) s LEFT JOIN corner_best c USING (image_id) LEFT JOIN pool_best a USING (image_id))"""


def as_record(texts: str, name: str, legacy: bool = False) -> str:
    """Record columns of a table ``s`` of region texts with its ``seconds`` and ``codes``."""
    third = "" if legacy else f", {corner('s.top_left_white')}"
    return f"SELECT s.image_id, {name} AS name, coalesce(seconds.v, {corner('s.top_right')}{third}) AS time, codes.code, {texts}"


def ctes(source: str, legacy: bool = False) -> str:
    code_source = f"SELECT image_id AS id, top_left || ' ' || top_left_white || ' ' || top_left_cyan AS x FROM ({source})"
    return f"{banner_ctes(f'SELECT image_id AS id, banner AS x FROM ({source})', legacy)}, {code_ctes(code_source, legacy)}"


def record(legacy: bool = False) -> str:
    texts = f"s.top_left, s.top_left_white, s.top_left_cyan, {strip('s.banner')} AS banner, s.top_right, s.bottom_left"
    return f"""WITH {name_priority(legacy)}, {ctes(SCREENS, legacy)}
{as_record(texts, 'names.name', legacy)}
FROM ({SCREENS}) s JOIN names USING (image_id) JOIN seconds ON seconds.id = s.image_id JOIN codes ON codes.id = s.image_id"""


def json(rows: str) -> str:
    """(image_id, json) of record rows."""
    texts = ", ".join(f"'{camel}': {plain}" for plain, camel in TEXTS.items())
    inner = "'extracted': {'name': name, 'time': time, 'code': code, 'texts': {" + texts + "}}"
    return f"SELECT image_id, CAST(to_json({{{inner}}}) AS VARCHAR) AS json FROM ({rows})"


#: Words of the six texts, one a line, dealt over the calls that read each region.
REGION_WORDS = "SELECT image_id, " + ", ".join(
    f"array_to_string(list_filter(string_split({t}, ' '), lambda w: w <> ''), ' ') AS {t}" for t in TEXTS
) + f" FROM ({SCREENS})"

_SIDES = ", ".join(f"('{roi}', {', '.join(f'CAST(trunc(8 * {f}::DOUBLE) AS INT)' for f in box)})" for roi, *box in REGIONS)
_CALLS = [(i, roi, "en", target) for i, (roi, target) in enumerate(ENGLISH)]
_CALLS += [(9 + 5 * k + i, roi, lang, None) for k, lang in enumerate(["ch", "korean", "japan"]) for i, roi in enumerate(NAMES)]
_ROWS = ", ".join(f"({i}, '{roi}', '{lang}', {repr(target) if target else 'NULL'})" for i, roi, lang, target in _CALLS)
#: What the trial engine reads off 8 by 8 pictures: the size of each crop that is not empty, and a second line.
SIZE_LINES = f"""
SELECT s_suppkey AS image_id, call_no, target, line_no, CASE line_no WHEN 0 THEN lang || ' ' || (x2 - x1) || 'x' || (y2 - y1) ELSE 'last' END AS text,
       CASE line_no WHEN 0 THEN 0.5::DOUBLE ELSE -1::DOUBLE END AS confidence
FROM supplier CROSS JOIN (VALUES {_ROWS}) c(call_no, roi, lang, target) JOIN (VALUES {_SIDES}) r(roi, x1, y1, x2, y2) USING (roi) CROSS JOIN (VALUES (0), (1)) l(line_no)
WHERE x2 > x1 AND y2 > y1"""
OCR_ADAPTER = f"SELECT image_id, call_no, line_no, text, confidence FROM ({SIZE_LINES})"


def image_extraction() -> str:
    said = ", ".join(f"coalesce(string_agg(text, ' ' ORDER BY call_no, line_no) FILTER (target = '{t}'), '') AS {t}" for t in TEXTS)
    rows = f"{as_record(', '.join(f's.{t}' for t in TEXTS), corner_name('s.bottom_left'))} FROM said s JOIN seconds ON seconds.id = s.image_id JOIN codes ON codes.id = s.image_id"
    return f"WITH said AS (SELECT image_id, {said} FROM ({SIZE_LINES}) GROUP BY image_id), {ctes('SELECT * FROM said')} {json(rows)}"


def mask(condition: str) -> str:
    """(image_id, lit): pixels of 8 by 8 pictures under a condition on h, s, v, after a 3x3 median and a 3x3 closing."""
    hexes = " || ".join(f"md5(CAST(s_suppkey AS VARCHAR) || '/{i}')" for i in range(12))
    byte = lambda k: f"CAST('0x' || substr(hexes, CAST(6 * p + {2 * k} + 1 AS BIGINT), 2) AS INT)"
    around = lambda f: f"c JOIN range(-1, 2) dy(j) ON true JOIN range(-1, 2) dx(i) ON true JOIN {f} n ON n.image_id = c.image_id"
    held = "n.y = greatest(0, least(7, c.y + j)) AND n.x = greatest(0, least(7, c.x + i))"
    inside = "n.y = c.y + j AND n.x = c.x + i"
    return f"""
WITH px AS (SELECT s_suppkey AS image_id, p // 8 AS y, p % 8 AS x, {byte(0)}::DOUBLE AS b, {byte(1)}::DOUBLE AS g, {byte(2)}::DOUBLE AS r
            FROM (SELECT s_suppkey, {hexes} AS hexes FROM supplier) CROSS JOIN range(64) t(p)),
spans AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
turned AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS deg FROM spans),
hsv AS (SELECT image_id, y, x, round_even((deg + CASE WHEN deg < 0 THEN 360 ELSE 0 END) / 2, 0) % 180 AS h, CASE WHEN v > 0 THEN round_even(255 * d / v, 0) ELSE 0 END AS s, v FROM turned),
hit AS (SELECT image_id, y, x, CAST({condition} AS INT) AS a FROM hsv),
calm AS (SELECT c.image_id, c.y, c.x, CAST(sum(n.a) >= 5 AS INT) AS a FROM hit {around('hit')} AND {held} GROUP BY ALL),
grown AS (SELECT c.image_id, c.y, c.x, max(n.a) AS a FROM calm {around('calm')} AND {inside} GROUP BY ALL),
closed AS (SELECT c.image_id, c.y, c.x, min(n.a) AS a FROM grown {around('grown')} AND {inside} GROUP BY ALL)
SELECT image_id, CAST(sum(a) AS BIGINT) AS lit FROM closed GROUP BY image_id"""


WHITE_MASK, CYAN_MASK = mask("s <= 60 AND v >= 190"), mask("h BETWEEN 80 AND 105 AND s >= 50 AND v >= 120")


def contrast_binary(side: int = 16) -> str:
    """(image_id, lit, marks) of ``side`` square pictures of 8 by 8 tiles: grey, tile histograms clipped and redistributed, maps of the
    four nearest tiles blended, a 3x3 Gaussian, then each pixel against a 31-wide Gaussian mean less 9."""
    tile = side // 8
    area, last = tile * tile, side - 1
    limit = max(3 * area // 256, 1)
    hexes = " || ".join(f"md5(CAST(s_suppkey AS VARCHAR) || '/{i}')" for i in range(3 * side * side // 16))
    byte = lambda k: f"CAST('0x' || substr(hexes, CAST(6 * p + {2 * k} + 1 AS BIGINT), 2) AS INT)"
    mirrored = lambda c: f"(CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {last} THEN {2 * last} - ({c}) ELSE {c} END)"
    held = lambda c: f"greatest(0, least({last}, {c}))"
    return f"""
WITH px AS MATERIALIZED (
  SELECT s_suppkey AS image_id, p // {side} AS y, p % {side} AS x, (3735 * {byte(0)} + 19235 * {byte(1)} + 9798 * {byte(2)} + 16384) >> 15 AS a
  FROM (SELECT s_suppkey, {hexes} AS hexes FROM supplier) CROSS JOIN range({side * side}) t(p)),
hist AS MATERIALIZED (SELECT image_id, y // {tile} AS ty, x // {tile} AS tx, a AS v, least(count(*), {limit}) AS c, greatest(count(*) - {limit}, 0) AS o FROM px GROUP BY ALL),
tiles AS MATERIALIZED (SELECT image_id, ty, tx, sum(o) AS over, sum(o) % 256 AS lone, list((v, c)) AS counts FROM hist GROUP BY ALL),
near AS (
  SELECT image_id, y, x, a, greatest(0, least(7, y0 + dy)) AS ty, greatest(0, least(7, x0 + dx)) AS tx, CASE dy WHEN 1 THEN fy ELSE 1 - fy END * CASE dx WHEN 1 THEN fx ELSE 1 - fx END AS w
  FROM (SELECT *, CAST(floor(y / {tile}.0 - 0.5) AS INT) AS y0, CAST(floor(x / {tile}.0 - 0.5) AS INT) AS x0,
               (y / {tile}.0 - 0.5) - floor(y / {tile}.0 - 0.5) AS fy, (x / {tile}.0 - 0.5) - floor(x / {tile}.0 - 0.5) AS fx FROM px)
  CROSS JOIN range(2) a(dy) CROSS JOIN range(2) b(dx)),
mapped AS (
  SELECT n.*, round_even((coalesce(list_sum(list_transform(list_filter(t.counts, lambda e: e[1] <= n.a), lambda e: e[2])), 0) * 1.0::DOUBLE
    + (over // 256) * (n.a + 1) + len(list_filter(range(CAST(lone AS BIGINT)), lambda i: i * greatest(256 // greatest(lone, 1), 1) <= n.a))) * 255 / {area}, 0) AS m
  FROM near n JOIN tiles t USING (image_id, ty, tx)),
even AS (SELECT image_id, y, x, round_even(sum(w * least(255, greatest(0, coalesce(m, 0)))), 0) AS a FROM mapped GROUP BY ALL),
soft AS MATERIALIZED (
  SELECT c.image_id, c.y, c.x, round_even(sum(n.a * CASE j WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * CASE i WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END), 0) AS a
  FROM even c JOIN range(-1, 2) dy(j) ON true JOIN range(-1, 2) dx(i) ON true JOIN even n ON n.image_id = c.image_id AND n.y = {mirrored('c.y + j')} AND n.x = {mirrored('c.x + i')} GROUP BY ALL),
kernel AS (SELECT k, e / sum(e) OVER () AS w FROM (SELECT k, exp(-(k * k) / 50.0::DOUBLE) AS e FROM range(-15, 16) t(k))),
down AS MATERIALIZED (SELECT c.image_id, c.y, c.x, sum(n.a * w) AS m FROM soft c CROSS JOIN kernel JOIN soft n ON n.image_id = c.image_id AND n.x = c.x AND n.y = {held('c.y + k')} GROUP BY ALL),
mean AS (SELECT c.image_id, c.y, c.x, sum(n.m * w) AS m FROM down c CROSS JOIN kernel JOIN down n ON n.image_id = c.image_id AND n.y = c.y AND n.x = {held('c.x + k')} GROUP BY ALL)
SELECT image_id, count(*) FILTER (s.a > round_even(m, 0) - 9) AS lit, coalesce(sum(y * {side} + x + 1) FILTER (s.a > round_even(m, 0) - 9), 0)::BIGINT AS marks
FROM soft s JOIN mean USING (image_id, y, x) GROUP BY image_id"""


#: Base64 texts of documents, spoilt in ten ways; p is the unpadded text, pad its padding.
SPOILT = """CASE doc_id % 10 WHEN 0 THEN p || pad WHEN 1 THEN substr(p, 1, 3) || '*~' || substr(p, 4) WHEN 2 THEN substr(p, 1, 6) || '=' || substr(p, 7) || pad
  WHEN 3 THEN substr(p, 1, 6) || '==' || substr(p, 7) WHEN 4 THEN p || pad || p WHEN 5 THEN substr(p, 1, length(p) - 1) WHEN 6 THEN ' =' || p || pad
  WHEN 7 THEN 'data:image/png;base64,' || p || pad WHEN 8 THEN p || 'é' ELSE '' END"""
_D = "[A-Za-z0-9+/]"
_GROUPS = f"^((?:=*{_D}=*{_D}=?{_D}{_D})*(?:=*{_D}=*{_D}==|=*{_D}=*{_D}=?{_D}=|=*$))"
BASE64_LENIENT = f"""
WITH t AS (SELECT doc_id, rtrim(to_base64(encode(source || lang || doc_id)), '=') AS p FROM documents),
x AS (SELECT doc_id, {SPOILT} AS x FROM (SELECT doc_id, p, repeat('=', CAST((4 - length(p) % 4) % 4 AS INT)) AS pad FROM t)),
body AS (SELECT doc_id, replace(CASE WHEN starts_with(x, 'data:') THEN substr(x, instr(x, ',') + 1) ELSE x END, ' ', '') AS x FROM x),
kept AS (SELECT doc_id, x, regexp_replace(rpad(x, CAST(ceil(length(x) / 4.0) * 4 AS INT), '='), '[^A-Za-z0-9+/=]', '', 'g') AS k FROM body),
good AS (SELECT doc_id, x <> '' AND NOT regexp_matches(x, '[^\x00-\x7F]') AND regexp_matches(k, '{_GROUPS}') AS ok, replace(regexp_extract(k, '{_GROUPS}', 1), '=', '') AS data FROM kept)
SELECT doc_id, CASE WHEN ok THEN 200 ELSE 400 END AS status, CASE WHEN ok THEN hex(from_base64(rpad(data, CAST(ceil(length(data) / 4.0) * 4 AS INT), '='))) END AS bytes FROM good"""


def answers(json_of: str) -> str:
    """Statuses and records of requests that hold pictures, spoilt by key, under the engines and profiles of ``answers_by_profile``."""
    return f"""
SELECT image_id, profile, CASE WHEN image_id % 5 IN (0, 1) THEN status ELSE 400 END AS status, CASE WHEN image_id % 5 IN (0, 1) AND status = 200 THEN json END AS json
FROM ({json_of}) CROSS JOIN (VALUES ('current', 200), ('current, no korean', 503), ('legacy, no korean', 200)) p(profile, status)"""
