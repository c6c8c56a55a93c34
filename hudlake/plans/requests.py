"""From addresses, base64 texts or folders of pictures to answers: status, detail and the JSON record, one row per request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake import staging
from hudlake.operators import ocr
from hudlake.plans import extract
from hudlake.schema import LANGUAGES
from hudlake.sources import inputs, pictures


def answers(requests: DataFrame, factory: ocr.Factory, profile: str = "current", session: Callable = inputs.HttpSession, engines: str | None = None) -> DataFrame:
    """(image_id, status, detail, json) of requests (image_id, image_url) or (image_id, image_b64); ids of any type.

    Engines are built on the workers first. Without the English one every request gets 503. Where another
    language is missing, profile ``current`` answers 503 for every image that could be read, and ``legacy``
    goes without that language. An engine that a worker cannot build later, during recognition, gives the same for the images
    that it was to read. Equal pictures are recognised once. A request that fails never fails the job.
    """
    ready, engines = _ready(requests.sparkSession, factory, profile, engines)
    if "en" not in ready:
        return _not_ready(requests)
    if "image_url" in requests.columns:
        told, found = pictures.of_bodies(inputs.fetched(requests, session, profile), inputs.STATUSES[profile]["page"])
    else:
        told, found = pictures.of_bodies(inputs.decoded(requests))
    return _answered(told, found, factory, profile, engines, ready)


def folder_answers(spark: SparkSession, path: str, factory: ocr.Factory, profile: str = "current", engines: str | None = None) -> DataFrame:
    """(image_id, status, detail, json) of all files below ``path``; an id is a file's path."""
    ready, engines = _ready(spark, factory, profile, engines)
    if "en" not in ready:
        return _not_ready(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("image_id")))
    told, found = pictures.of_folder(spark, path)
    return _answered(told, found, factory, profile, engines, ready)


def _ready(spark: SparkSession, factory: ocr.Factory, profile: str, engines: str | None) -> tuple[list[str], str]:
    engines = engines or ocr.engine_name(factory)
    return ocr.warm_workers(spark, factory, ["en", *LANGUAGES[profile]], engines), engines


def _not_ready(requests: DataFrame) -> DataFrame:
    return requests.select("image_id", F.lit(503).alias("status"), F.lit("recognition models not ready yet").alias("detail"), F.lit(None).cast("string").alias("json"))


def _answered(told: DataFrame, found: DataFrame, factory: ocr.Factory, profile: str, engines: str, ready: list[str]) -> DataFrame:
    """Records of the usable pictures ``found``, joined to the rows ``told`` that hold them."""
    missing = [x for x in LANGUAGES[profile] if x not in ready]
    if missing and profile == "current":
        bad = F.col("status") == 200
        return told.select(
            "image_id", F.when(bad, 503).otherwise(F.col("status")).alias("status"),
            F.when(bad, f"recognition model {missing[0]!r} not loaded").otherwise(F.col("detail")).alias("detail"), F.lit(None).cast("string").alias("json"),
        )
    lines = extract.image_lines(found, factory, profile, engines, [x for x in ready if x != "en"])
    record = extract.as_json(extract.with_empty(found, extract.extract(ocr.read(lines), profile)))
    gone = ocr.without_engine(lines, profile).withColumnRenamed("language_code", "gone")
    record = staging.stage(record.join(gone, "image_id", "left").withColumnRenamed("image_id", "picture"), "records")
    rows = told.join(record, "picture", "left")
    bad = F.col("gone").isNotNull()
    return rows.select(
        "image_id", F.when(bad, 503).otherwise(F.col("status")).alias("status"),
        F.when(bad, F.concat(F.lit("recognition model '"), "gone", F.lit("' not loaded"))).otherwise(F.col("detail")).alias("detail"),
        F.when(~bad, F.col("json")).alias("json"),
    )
