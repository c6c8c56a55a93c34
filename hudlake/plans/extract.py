"""From recognised lines to one record per image: name, time, code and the six region texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hudlake import staging
from hudlake.functions import clock, mapcode
from hudlake.functions import playername as N
from hudlake.functions import text as T
from hudlake.operators import ocr
from hudlake.operators.images import crops
from hudlake.schema import LANGUAGES, TEXTS


def joined_lines(lines: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, text): the lines of a group in order, with single spaces between."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return lines.groupBy(*keys).agg(T.strip(F.array_join(F.transform(ordered, lambda x: x[text]), " ")).alias(text))


def ordered_texts() -> Column:
    """Aggregate: what the English calls of an image read, in order."""
    return F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("call_no", "line_no", "target", "text"))))


def with_region_texts(df: DataFrame, said: str) -> DataFrame:
    """``df`` with the six texts, never null, in place of column ``said`` of ``ordered_texts``."""
    of = lambda name: F.transform(F.filter(said, lambda x: x["target"] == name), lambda x: x["text"])
    return df.select(*[c for c in df.columns if c != said], *[T.strip(F.array_join(of(name), " ")).alias(name) for name in TEXTS])


def region_texts(lines: DataFrame, profile: str = "current") -> DataFrame:
    """(image_id, six texts), with one shuffle on image_id."""
    said = ocr.labelled(lines, profile).groupBy("image_id").agg(ordered_texts().alias("_said_lines"))
    return with_region_texts(said, "_said_lines")


def gated(candidates: DataFrame) -> DataFrame:
    """Where any candidate of an image is clearly Hangul, the others must be somewhat so, or Korean."""
    any_hangul = F.max("hangul").over(Window.partitionBy("image_id")) >= N.GATE
    return candidates.withColumn("_any", any_hangul).where(~F.col("_any") | somewhat_hangul()).drop("_any")


def somewhat_hangul() -> Column:
    return (F.col("hangul") >= N.GATE_KEEPS) | (F.col("language_code") == "korean")


def rated(candidates: DataFrame) -> DataFrame:
    """Candidates with ``cleaned`` text, ``score``, and whether the text and its script allow them into the pool."""
    shares = {s: F.col(s) for s in ("hangul", "kana", "han")}
    score = N.candidate_score(F.col("confidence"), F.col("language_code"), F.col("roi_label"), shares)
    eligible = (F.greatest(*shares.values()) >= N.LEAST_SCRIPT) & (F.length(T.without_white(F.col("cleaned"))) >= 2)
    return candidates.withColumn("cleaned", N.banner_fragment(F.col("text"))).withColumns({"score": score, "pooled": eligible})


def scored(candidates: DataFrame) -> DataFrame:
    """The pool of candidates with cleaned text and score."""
    return rated(gated(candidates)).where("pooled").withColumn("text", F.col("cleaned")).drop("cleaned", "pooled")


def best_name(among: Column | None = None) -> Column:
    """Aggregate over ``rated`` rows: the pooled text of the highest score, the earliest of equal ones; gated as ``gated`` does.

    The gate depends on all candidates of the image, so the best one is kept for either outcome and the choice
    comes last: no candidate is gathered or sorted.
    """
    mine = F.col("roi_label").isNotNull() if among is None else among
    place = F.struct("score", -F.col("call_no"), -F.col("line_no"))
    best = lambda allowed: F.max_by("cleaned", F.when(allowed & F.col("pooled"), place))
    return F.when(F.max(F.when(mine, F.col("hangul"))) >= N.GATE, best(mine & somewhat_hangul())).otherwise(best(mine))


def best_names(candidates: DataFrame) -> DataFrame:
    """(image_id, name) of the images that have a name."""
    return rated(candidates).groupBy("image_id").agg(best_name().alias("name")).where("name IS NOT NULL")


def cjk_names(candidates: DataFrame) -> DataFrame:
    """(image_id, cjk_corner, cjk_all): the best names of the corner and of all regions."""
    return rated(candidates).groupBy("image_id").agg(*both_names())


def both_names() -> list[Column]:
    return [best_name(F.col("roi_label") == "BL").alias("cjk_corner"), best_name().alias("cjk_all")]


def records(texts: DataFrame, names: DataFrame | None = None, profile: str = "current") -> DataFrame:
    """(image_id, name, time, code, texts) of region texts and CJK names (image_id, cjk_corner, cjk_all)."""
    legacy = profile == "legacy"
    if names is not None:
        texts = texts.join(names, "image_id", "left")
    elif "cjk_all" not in texts.columns:
        texts = texts.withColumns({c: F.lit(None).cast("string") for c in ("cjk_corner", "cjk_all")})
    read = N.with_other_name(N.with_corner_name(texts, "bottom_left", "corner"), "banner", "top_right", "other")
    read = clock.with_run_seconds(read, "banner", "top_right", "top_left_white", "time", legacy)
    read = mapcode.with_code(read, ["top_left", "top_left_white", "top_left_cyan"], "code", legacy)
    name = N.preferred_name(*[F.col(c) for c in ("corner", "cjk_corner", "other", "cjk_all")], legacy)
    return read.select("image_id", name.alias("name"), "time", "code", F.struct(*TEXTS).alias("texts"))


def extract(lines: DataFrame, profile: str = "current") -> DataFrame:
    """Records of recognised lines (image_id, call_no, line_no, text, confidence): one pass, one shuffle on image_id."""
    every = ocr.labelled(lines, profile)
    shown = every.withColumns({"whole": F.col("text"), "text": F.when(F.col("roi_label").isNotNull(), F.col("text"))})
    judged = rated(ocr.with_profile(shown)).withColumn("text", F.col("whole"))
    return records(with_region_texts(judged.groupBy("image_id").agg(ordered_texts().alias("_said_lines"), *both_names()), "_said_lines"), None, profile)


def image_lines(
    images: DataFrame, factory: ocr.Factory, profile: str = "current", engines: str | None = None, languages: list[str] | None = None
) -> DataFrame:
    """What recognition says of images (see ``ocr.recognise``), recognising names in other scripts only where the corner shows no ASCII name.

    An ASCII name in the corner wins over every other, so the 15 calls of the other languages cannot
    change such a record and are left out. Recognised lines are written to the shared folder: a lost
    executor costs no second recognition. ``languages`` are those of names, by default all of the profile.
    """
    languages = LANGUAGES[profile] if languages is None else languages
    english = staging.stage(ocr.recognise(crops(images, profile, ["en"]), factory, engines), "english-lines")
    corner = N.with_corner_name(region_texts(ocr.read(english), profile), "bottom_left", "corner").where("corner IS NOT NULL").select("image_id")
    open_images = images.join(corner, "image_id", "left_anti")
    return english.union(staging.stage(ocr.recognise(crops(open_images, profile, languages), factory, engines), "other-lines"))


def with_empty(images: DataFrame, found: DataFrame) -> DataFrame:
    """Records ``found`` of all ``images``; one of empty texts for those without a line."""
    none = F.struct(*[F.lit("").alias(t) for t in TEXTS])
    return images.select("image_id").join(found, "image_id", "left").withColumn("texts", F.coalesce("texts", none))


def extract_images(
    images: DataFrame, factory: ocr.Factory, profile: str = "current", engines: str | None = None, languages: list[str] | None = None
) -> DataFrame:
    """Records of images (see ``image_lines``). Images without a line, and rows that hold no image, get a record of empty texts.

    A language whose engine a worker cannot build reads nothing; ``requests.answers`` turns that into a status.
    """
    lines = image_lines(images, factory, profile, engines, languages)
    return with_empty(images, extract(ocr.read(lines), profile))


def camel(name: str) -> str:
    """First part as it is, the others with a capital: top_left -> topLeft, b2c_d -> b2cD."""
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def as_json(extracted: DataFrame) -> DataFrame:
    """(image_id, json): the record in camel case, nulls included."""
    texts = F.struct(*[F.col(f"texts.{t}").alias(camel(t)) for t in TEXTS])
    return extracted.select("image_id", F.to_json(F.struct(F.struct("name", "time", "code", texts.alias("texts")).alias("extracted")), {"ignoreNullFields": "false"}).alias("json"))
