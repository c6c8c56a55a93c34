"""Relations of the extraction engine and its fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



def id_type(df: DataFrame) -> str:
    """Type of the images' ids: numbers, or strings such as paths and digests; every relation carries them as they come."""
    return dict(df.dtypes)["image_id"]


def ocr_lines(kind: str = "long") -> str:
    return f"image_id {kind}, call_no int, line_no int, text string, confidence double"


OCR_LINES = ocr_lines()

# Regions as fractions of width and height (left, top, right, bottom).
REGIONS = {
    "TOPLEFT": (0.010, 0.020, 0.360, 0.300),
    "TOPLEFT_WIDE": (0.005, 0.010, 0.420, 0.340),
    "BANNER": (0.220, 0.180, 0.780, 0.360),
    "TOPRIGHT": (0.800, 0.170, 0.985, 0.470),
    "BOTTOMLEFT": (0.050, 0.825, 0.330, 0.990),
    "NAME": (0.050, 0.800, 0.400, 0.900),
}
# What English recognition reads, in order, and the text that each call adds to.
ENGLISH_CALLS = [
    ("BANNER", "raw", "banner"), ("BANNER", "white", "banner"), ("BANNER", "binary", "banner"), ("TOPRIGHT", "raw", "top_right"),
    ("BOTTOMLEFT", "raw", "bottom_left"), ("TOPLEFT", "raw", "top_left"), ("TOPLEFT_WIDE", "raw", "top_left"),
    ("TOPLEFT_WIDE", "white", "top_left_white"), ("TOPLEFT_WIDE", "cyan", "top_left_cyan"),
]
# What each other language reads, and the label of its candidates.
NAME_CALLS = [("NAME", "raw", "BL"), ("BOTTOMLEFT", "raw", "BL"), ("BANNER", "raw", "BAN"), ("BANNER", "white", "BAN"), ("BANNER", "binary", "BAN")]
LANGUAGES = {"current": ["ch", "korean", "japan"], "legacy": ["korean", "japan", "ch"]}
TEXTS = ["top_left", "top_left_white", "top_left_cyan", "banner", "top_right", "bottom_left"]


def region_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGIONS.items()], "roi string, x1 double, y1 double, x2 double, y2 double")


def call_plan(spark: SparkSession, profile: str = "current") -> DataFrame:
    """The recognition calls of one image, in order. Names of candidates have a label, regions a target."""
    calls = [(roi, variant, "en", None, target) for roi, variant, target in ENGLISH_CALLS]
    calls += [(roi, variant, lang, label, None) for lang in LANGUAGES[profile] for roi, variant, label in NAME_CALLS]
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(calls)], "call_no int, roi string, variant string, language_code string, roi_label string, target string"
    )
