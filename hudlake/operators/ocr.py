"""Recognition as a table function with a pluggable engine.

An engine is a callable (image array, language) -> blocks, where a block is (text, confidence) or
[box, (text, confidence)], and all blocks may stand in one more list, as recognisers return them. An engine with a
method ``many(list of images, language) -> list of such answers`` gets the crops of a language in groups. A
factory builds one engine per language; each Python worker builds an engine once and keeps it for its
later tasks, under a name that stands for the factory and all that it holds.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.functions import playername as N
from hudlake.operators.images import three_channels
from hudlake.schema import call_plan, id_type, ocr_lines
from hudlake.sources.inputs import model_folders

log = logging.getLogger(__name__)

UNKNOWN_CONFIDENCE = -1.0
LOADED: dict[tuple[str, str], Any] = {}
Factory = Callable[[str], Callable[[np.ndarray, str], Any]]

# How the recogniser is set up.
ENGINE_OPTIONS = {
    "ocr_version": "PP-OCRv3", "use_angle_cls": False, "show_log": False, "enable_mkldnn": False, "use_gpu": False,
    "det_batch_num": 1, "rec_batch_num": 1, "cls_batch_num": 1,
}


def recogniser(root: str) -> Factory:
    """Factory of engines over the model folders below ``root``; building one fails where the library is missing."""

    def factory(language: str):
        from paddleocr import PaddleOCR

        detection, recognition = model_folders(language, root)
        engine = PaddleOCR(lang=language, det_model_dir=detection, rec_model_dir=recognition, **ENGINE_OPTIONS)
        return lambda image, _: engine.ocr(image, cls=False)

    return factory


def engine_name(factory: Factory) -> str:
    """A name for a factory and the values that it closes over."""
    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def engine_for(factory: Factory, language: str, name: str | None = None):
    key = (name or engine_name(factory), language)
    if key not in LOADED:
        LOADED[key] = factory(language)
    return LOADED[key]


def said(x: Any) -> tuple | list | None:
    """The (text, confidence) pair of a block, or None for a malformed one."""
    if not isinstance(x, (list, tuple)) or len(x) < 2:
        return None
    pair = x if isinstance(x[0], str) else x[1]
    return pair if isinstance(pair, (list, tuple)) and len(pair) >= 2 and (pair[0] is None or isinstance(pair[0], str)) else None


def lines_of(result: Any) -> list[tuple[str, float]]:
    """Clean lines out of an engine's answer: malformed blocks and empty texts go, order stays."""
    blocks, out = list(result or []), []
    if blocks and isinstance(blocks[0], list) and said(blocks[0]) is None:
        blocks = blocks[0]
    for pair in filter(None, map(said, blocks)):
        text = (pair[0] or "").strip()
        try:
            confidence = UNKNOWN_CONFIDENCE if pair[1] is None else float(pair[1])
        except (TypeError, ValueError):
            confidence = UNKNOWN_CONFIDENCE
        if text:
            out.append((text, confidence))
    return out


#: Pixels, in bytes, of the crops that an engine gets in one call, where it takes several.
GROUP_BYTES = 16 << 20
#: ``line_no`` of the row that stands for a crop whose engine this worker could not build; its text is the language.
NO_ENGINE = -1


def answers_of(engine: Callable, images: list[np.ndarray], language: str) -> list[list[tuple[str, float]]]:
    """Lines of each image, by one call where the engine takes several; an image on which it fails has none."""
    if hasattr(engine, "many") and len(images) > 1:
        try:
            found = list(engine.many(images, language))
            if len(found) == len(images):
                return list(map(lines_of, found))
            log.warning("recognition (%s) gave %d answers for %d crops", language, len(found), len(images))
        except Exception as error:  # one crop may have spoilt the call: each gets its own
            log.warning("recognition (%s) of %d crops failed: %s", language, len(images), error)
    out = []
    for image in images:
        try:
            out.append(lines_of(engine.many([image], language)[0] if hasattr(engine, "many") else engine(image, language)))
        except Exception as error:  # a crop that cannot be read has no lines
            log.warning("recognition (%s) failed: %s", language, error)
            out.append([])
    return out


def recognise(crops: DataFrame, factory: Factory, name: str | None = None) -> DataFrame:
    """OCR lines of crops; an empty crop and a crop on which the engine fails have none.

    A crop whose engine the worker cannot build gives one row with ``line_no`` ``NO_ENGINE`` instead (see ``read`` and
    ``without_engine``): a worker that starts late, or fails alone, costs the images of its task and never the job.
    Crops of a language are gathered over batches up to ``GROUP_BYTES``.
    """
    name = name or engine_name(factory)

    def run(batches):
        import pandas as pd

        waiting: dict[str, list[tuple]] = {}
        size: dict[str, int] = {}
        failed: dict[str, bool] = {}  # a language is tried once a task

        def lines(language):
            group, out = waiting.pop(language), []
            size[language] = 0
            if language not in failed:
                failed[language] = not warm(factory, [language], name)
            if failed[language]:
                out = [(k, call, NO_ENGINE, language, None) for k, call, _ in group]
            else:
                found = answers_of(engine_for(factory, language, name), [image for _, _, image in group], language)
                out = [(k, call, i, t, c) for (k, call, _), said_ in zip(group, found) for i, (t, c) in enumerate(said_)]
            return pd.DataFrame(out, columns=["image_id", "call_no", "line_no", "text", "confidence"]).astype({"confidence": "f8"})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.height == 0 or row.width == 0:
                    continue
                image = three_channels(np.frombuffer(row.data, "u1").reshape(row.height, row.width, row.channels))
                waiting.setdefault(row.language_code, []).append((row.image_id, row.call_no, image))
                size[row.language_code] = size.get(row.language_code, 0) + image.nbytes
                if size[row.language_code] >= GROUP_BYTES:
                    yield lines(row.language_code)
        for language in list(waiting):
            yield lines(language)

    return crops.mapInPandas(run, ocr_lines(id_type(crops)))


def read(lines: DataFrame) -> DataFrame:
    """The lines that were read."""
    return lines.where(F.col("line_no") != NO_ENGINE)


def without_engine(lines: DataFrame, profile: str = "current") -> DataFrame:
    """(image_id, language_code) of images that lacked an engine, the first such language in the order of calls.

    Profile ``legacy`` goes without a language of names; English must be there.
    """
    gone = lines.where(F.col("line_no") == NO_ENGINE)
    gone = gone.where(F.col("text") == "en") if profile == "legacy" else gone
    return gone.groupBy("image_id").agg(F.min_by("text", "call_no").alias("language_code"))


def warm(factory: Factory, languages: list[str], name: str | None = None) -> list[str]:
    """Build engines ahead in this process; languages that cannot be built are logged and left out."""
    ready = []
    for language in languages:
        try:
            engine_for(factory, language, name)
            ready.append(language)
        except Exception as error:
            log.warning("no %s engine: %s", language, error)
    return ready


def warm_workers(spark: SparkSession, factory: Factory, languages: list[str], name: str | None = None) -> list[str]:
    """Build engines in the Python workers, one task a core, and return the languages that every task could build."""
    name, tasks = name or engine_name(factory), spark.sparkContext.defaultParallelism

    def run(batches):
        import pandas as pd

        for _ in batches:
            ready = warm(factory, languages, name)
            yield pd.DataFrame({"language": languages, "ok": [x in ready for x in languages]})

    built = spark.range(0, tasks, 1, tasks).mapInPandas(run, "language string, ok boolean").groupBy("language").agg(F.min("ok").alias("ok"))
    ready = {r.language for r in built.where("ok").collect()}
    return [x for x in languages if x in ready]


def require_engine(languages: list[str], needed: str = "en") -> None:
    if needed not in languages:
        raise RuntimeError(f"status 503: the {needed} engine is not loaded")


def engine_status(spark: SparkSession, languages: list[str], legacy: bool = False) -> DataFrame:
    """One row: ok, and the loaded languages, sorted unless ``legacy`` keeps their order."""
    return spark.createDataFrame([(True, languages if legacy else sorted(languages))], "ok boolean, models array<string>")


def labelled(lines: DataFrame, profile: str = "current") -> DataFrame:
    """Lines with what their call says: language, label or target. (call_no, line_no) is their place in order."""
    return lines.join(F.broadcast(call_plan(lines.sparkSession, profile)), "call_no")


def with_profile(labelled_lines: DataFrame) -> DataFrame:
    """Labelled lines as candidates, with the shares of the scripts that names are judged by."""
    known = labelled_lines.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return N.with_scripts(known, "text", ["hangul", "kana", "han"])


def candidates(lines: DataFrame, profile: str = "current") -> DataFrame:
    """Name candidates (image_id, call_no, line_no, text, confidence, language_code, roi_label) with their script shares."""
    named = labelled(lines, profile).where("roi_label IS NOT NULL")
    return with_profile(named.select("image_id", "call_no", "line_no", "text", "confidence", "language_code", "roi_label"))
