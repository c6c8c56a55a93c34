"""Extraction over a folder that image lines keep arriving in. An extension of the batch plan.

The lines of an image are keyed state of the query, so a batch reads and changes the state of the images that it
touches and no other; its records are made from those images' lines, all so far. So an image whose lines come in several
batches has a record in each of them, the last one whole; ``latest`` reads the one of the most lines.
State goes when batches have gone on for ``idle`` after its last line; a line that comes later still makes a record of its own, which has fewer lines and so does
not replace the whole one. A line that comes again (same call and place) replaces the first. A batch
that runs again after a failure finds the state of the batch before it and writes the same files again.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from hudlake import staging
from hudlake.plans.extract import as_json, extract
from hudlake.schema import ocr_lines

#: Milliseconds without a line after which an image's state goes.
IDLE = 3_600_000


def gathered(lines: DataFrame, kind: str, idle: int) -> DataFrame:
    """For each batch of streamed lines, all lines so far of the images that it touches."""

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        known = {(c, n): (t, p) for c, n, t, p in json.loads(state.get[0])} if state.exists else {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                confidence = None if row.confidence is None or math.isnan(row.confidence) else float(row.confidence)
                known[int(row.call_no), int(row.line_no)] = (row.text, confidence)
        flat = [(c, n, t, p) for (c, n), (t, p) in sorted(known.items())]
        state.update((json.dumps(flat),))
        state.setTimeoutTimestamp(state.getCurrentProcessingTimeMs() + idle)
        yield pd.DataFrame([(key[0], *r) for r in flat], columns=["image_id", "call_no", "line_no", "text", "confidence"]).astype({"text": "object", "confidence": "f8"})

    good = lines.where("image_id IS NOT NULL AND call_no IS NOT NULL AND line_no IS NOT NULL")
    seen = good.withColumn("seen", F.current_timestamp()).withWatermark("seen", "0 seconds")  # the time of the batch: no line is late
    return seen.groupBy("image_id").applyInPandasWithState(run, ocr_lines(kind), "lines string", "update", GroupStateTimeout.EventTimeTimeout)


def watch_lines(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "current", idle: int = IDLE, kind: str = "long", batch_files: int | None = None) -> StreamingQuery:
    """Keep ``out`` up to date with the OCR-line files of ``folder``, whose ids are of type ``kind``; runs over what is there and stops.

    ``batch_files`` bounds the files of one batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        whole = staging.stage(batch, "touched")  # the state function runs once a batch
        sizes = whole.groupBy("image_id").agg(F.count("*").alias("lines"))
        as_json(extract(whole, profile)).join(sizes, "image_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        staging.drop_stage(whole)

    source = spark.readStream.schema(ocr_lines(kind))
    lines = (source.option("maxFilesPerTrigger", batch_files) if batch_files else source).parquet(folder)
    return gathered(lines, kind, idle).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, kind: str = "long") -> DataFrame:
    """(image_id, json): each image's record of the most lines, the last one of equals."""
    found = spark.read.schema(f"image_id {kind}, json string, lines long, batch int").parquet(out)
    return found.groupBy("image_id").agg(F.max_by("json", F.struct("lines", "batch")).alias("json"))
