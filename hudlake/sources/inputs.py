"""Where images and model files come from: tables of base64 text or addresses, and model folders."""

from __future__ import annotations

import logging
import os
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hudlake.functions import text as T
from hudlake.schema import id_type

log = logging.getLogger(__name__)

# What a profile reports for a page that is not there or no image, for a network error, and for anything else.
STATUSES = {"current": {"page": 500, "network": 400, "other": 500}, "legacy": {"page": 400, "network": 500, "other": 500}}
# Folders of detection and recognition models by language.
MODELS = {
    "en": ("det/en/en_PP-OCRv3_det_infer", "rec/en/en_PP-OCRv3_rec_infer"),
    "ch": ("det/ch/ch_PP-OCRv3_det_infer", "rec/ch/ch_PP-OCRv3_rec_infer"),
    "korean": ("det/ml/Multilingual_PP-OCRv3_det_infer", "rec/korean/korean_PP-OCRv3_rec_infer"),
    "japan": ("det/ml/Multilingual_PP-OCRv3_det_infer", "rec/japan/japan_PP-OCRv3_rec_infer"),
}


def padded_base64(x: Column) -> Column:
    """Base64 text without white space, in the standard alphabet, padded to whole groups of four."""
    plain = F.translate(T.without_white(x), "-_", "+/")
    return F.rpad(plain, F.ceil(F.length(plain) / F.lit(4)).cast("int") * 4, "=")


def payload(x: Column) -> Column:
    """What stands behind the first comma of a data: address, or the text itself; null where there is no comma."""
    return F.when(~F.startswith(x, F.lit("data:")), x).when(F.instr(x, ",") > 0, F.substring(x, F.instr(x, ",") + 1, F.length(x)))


def lenient_base64(x: Column) -> Column:
    """Bytes of base64 text as a tolerant decoder reads it; null where it gives up.

    Characters outside the alphabet are left out. A group of four ends early at its padding, two marks after two
    characters or one after three, other characters before it or none; nothing behind it is read. Padding elsewhere
    is left out too. A text that ends inside a group, or holds a character that is not ASCII, cannot be read.
    """
    kept = F.regexp_replace(x, "[^A-Za-z0-9+/=]+", "")
    runs = F.split(kept, "=")
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("pads"), F.lit(-1).alias("stop"))

    def mark(state: Column, run: Column) -> Column:
        """After a run of characters and the padding mark behind it."""
        n = state["n"] + F.length(run)
        late = F.pmod(n, F.lit(4)) >= 2
        pads = F.when(F.length(run) > 0, 0).otherwise(state["pads"]) + F.when(late, 1).otherwise(0)
        stop = F.when(state["stop"] >= 0, state["stop"]).when(late & (F.pmod(n, F.lit(4)) + pads >= 4), n).otherwise(-1)
        return F.struct(n.alias("n"), pads.alias("pads"), stop.alias("stop"))

    stop = F.aggregate(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), begin, mark, lambda state: state["stop"])
    plain = F.replace(kept, F.lit("="), F.lit(""))
    whole = F.when(stop >= 0, F.substring(plain, F.lit(1), stop)).when(F.length(plain) % 4 == 0, plain)
    return F.when(~F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), F.try_to_binary(F.rpad(whole, F.ceil(F.length(whole) / F.lit(4)).cast("int") * 4, "="), F.lit("base64")))


def decoded(images: DataFrame, column: str = "image_b64") -> DataFrame:
    """``images`` with bytes, status and detail; a bad row gets status 400 and never fails the job."""
    body = payload(F.col(column))
    data = lenient_base64(padded_base64(body))
    bad = F.coalesce(F.length(body) == 0, F.lit(True)) | data.isNull()
    return images.withColumns({"bytes": data, "status": F.when(bad, 400).otherwise(200), "detail": F.when(bad, F.lit("invalid base64 image"))})


#: Addresses that a task asks for at a time, attempts for each, seconds before the second one (doubled for the third),
#: and bytes of answers that a task holds before it passes them on.
AT_ONCE, ATTEMPTS, BACK_OFF, HELD_BYTES = 16, 3, 0.2, 32 << 20
#: Answers of a server that may be better the next time.
PASSING = {429, 500, 502, 503, 504}


class TooLarge(ValueError):
    """An answer beyond the bound on its bytes."""


class HttpSession(AbstractContextManager):
    """The default session: one opener, which keeps cookies and proxies, for all addresses of a task.

    ``timeout`` bounds each wait for a server, ``deadline`` the whole of an answer, ``most`` its bytes.
    """

    def __init__(self, timeout: float = 20.0, deadline: float = 60.0, most: int = 64 << 20):
        self.opener, self.timeout, self.deadline, self.most = urllib.request.build_opener(), timeout, deadline, most

    def get(self, url: str) -> tuple[int, bytes]:
        until = time.monotonic() + self.deadline
        try:
            with self.opener.open(url, timeout=self.timeout) as answer:
                parts, size = [], 0
                while part := answer.read1(1 << 16):
                    parts.append(part)
                    size += len(part)
                    if size > self.most:
                        raise TooLarge(f"more than {self.most} bytes")
                    if time.monotonic() > until:
                        raise TimeoutError(f"no whole answer within {self.deadline:g} s")
                return answer.status, b"".join(parts)
        except urllib.error.HTTPError as error:
            return error.code, b""

    def __exit__(self, *_) -> None:
        self.opener.close()


def asked(http, url, status_of: dict[str, int], attempts: int = ATTEMPTS, wait: float = BACK_OFF) -> tuple[int, str | None, bytes | None]:
    """(status, detail, bytes) of one address, asked again after network errors and passing troubles of the server."""
    if not isinstance(url, str) or not url.startswith(("http://", "https://")):
        return 422, "not an http address", None
    for left in reversed(range(attempts)):
        try:
            code, body = http.get(url)
            if code == 200:
                return 200, None, body
            status, detail = status_of["page"], f"failed to fetch image: HTTP {code}"
            if code not in PASSING:
                break
        except TooLarge as error:
            return status_of["page"], f"failed to fetch image: {error}", None
        except OSError as error:
            status, detail = status_of["network"], f"error fetching image: {error}"
        except Exception as error:
            return status_of["other"], f"unexpected error: {error}", None
        if left:
            time.sleep(wait)
            wait *= 2
    return status, detail, None


def fetched(requests: DataFrame, session: Callable[[], AbstractContextManager] = HttpSession, profile: str = "current", at_once: int = AT_ONCE, attempts: int = ATTEMPTS) -> DataFrame:
    """(image_id, status, detail, bytes) of addressed images.

    ``session`` is called once a partition; what it returns is a context manager whose ``get(url) -> (status, bytes)``
    several threads may call. A task has ``at_once`` addresses under way and as many answers waiting at most, so one that hangs
    keeps one thread and no other; answers leave in the order of the requests, in batches of ``HELD_BYTES``.
    """
    status_of, kind, id_kind = STATUSES[profile], id_type(requests), requests.schema["image_id"].dataType

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        id_arrow = to_arrow_type(id_kind)
        ids, got, size = [], [], 0

        def out():
            status, detail, body = zip(*got)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_arrow), pa.array(status, "int32"), pa.array(detail, "string"), pa.array(body, "binary")], names=["image_id", "status", "detail", "bytes"]
            )

        under_way: deque = deque()
        with session() as http, ThreadPoolExecutor(at_once) as threads:
            rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
            more = True
            while more or under_way:
                while more and len(under_way) < 2 * at_once:
                    row = next(rows, None)
                    more = row is not None
                    if more:
                        under_way.append((row[0], threads.submit(asked, http, row[1], status_of, attempts)))
                if under_way:
                    image_id, answer = under_way.popleft()
                    ids.append(image_id)
                    got.append(answer.result())
                    size += len(got[-1][2] or b"")
                    if size >= HELD_BYTES or len(ids) >= 1000:
                        yield out()
                        ids, got, size = [], [], 0
            if ids:
                yield out()

    return requests.select("image_id", "image_url").mapInArrow(run, f"image_id {kind}, status int, detail string, bytes binary")


def model_folders(language: str, root: str) -> tuple[str | None, str | None]:
    """Existing detection and recognition folders of a language; None for what is missing or unknown."""
    return tuple(p if os.path.isdir(p) else None for p in (os.path.join(root, x) for x in MODELS[language])) if language in MODELS else (None, None)


def model_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(k, *model_folders(k, root)) for k in MODELS], "language string, det string, rec string")


def log_model_folders(root: str) -> None:
    for language in MODELS:
        log.info("models of %s: detection %s, recognition %s", language, *model_folders(language, root))
