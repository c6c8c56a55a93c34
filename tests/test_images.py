"""Pixel kernels on arrays worked out by hand, crops, base64 input and the streaming wrapper."""

import base64
import binascii
import json
import struct
import time
import zlib

import numpy as np
import pytest
from hudlake.catalog import size_engine
from hudlake.operators import images, ocr
from hudlake.plans import extract, requests
from hudlake.sources import inputs, pictures
from hudlake.streaming.watch import latest, watch_lines


def solid(bgr, h=12, w=12):
    return np.tile(np.array(bgr, "u1"), (h, w, 1))


def test_hsv():
    x = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255], [0, 0, 0], [128, 64, 64]]], "u1")
    assert images.hsv(x)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0], [120, 128, 128]]


def test_masks():
    assert (images.white_mask(solid((255, 255, 255))) == 255).all() and not images.white_mask(solid((255, 0, 0))).any()
    assert (images.cyan_mask(solid((255, 255, 0))) == 255).all() and not images.cyan_mask(solid((255, 255, 255))).any()
    speck = solid((0, 0, 0))
    speck[5, 5] = 255
    assert not images.white_mask(speck).any()  # the median takes single pixels away
    gap = solid((255, 255, 255))
    gap[:, 6] = 0
    assert images.white_mask(gap)[:, 6].any()  # closing fills a one-pixel gap
    assert images.white_mask(np.zeros((0, 4, 3), "u1")).shape == (0, 4)


def test_contrast_and_threshold():
    flat = solid((10, 10, 10), 40, 40)
    assert len(np.unique(images.contrast(flat))) == 1
    assert (images.binarized(np.full((40, 40), 77, "u1")) == 255).all()
    step = np.full((40, 40), 200, "u1")
    step[18:22, 18:22] = 0
    out = images.binarized(step)
    assert not out[19:21, 19:21].any() and out[0, 0] == 255
    assert images.equalized(np.arange(64 * 64, dtype="u8").reshape(64, 64).astype("u1")).shape == (64, 64)


def test_crop_bounds(spark):
    got = {r.roi: tuple(r)[2:] for r in images.crop_bounds(spark.createDataFrame([(1, 1920, 1080)], "image_id long, width int, height int")).collect()}
    for roi, (x1, y1, x2, y2) in got.items():
        region = images.region_spec(spark).where(f"roi = '{roi}'").first()
        assert (x1, y1, x2, y2) == (int(1920 * region.x1), int(1080 * region.y1), int(1920 * region.x2), int(1080 * region.y2))
        assert images.crop(np.zeros((1080, 1920, 3), "u1"), tuple(region)[1:]).shape == (y2 - y1, x2 - x1, 3)
    assert len(got) == 6


def test_recognition_and_short_cut(spark):
    image = solid((200, 200, 200), 40, 60)
    rows = spark.createDataFrame([(1, 40, 60, 3, bytearray(image.tobytes()))], "image_id long, height int, width int, channels int, data binary")
    lines = ocr.recognise(images.crops(rows), size_engine).collect()
    assert {r.call_no for r in lines} == set(range(24)) and {r.line_no for r in lines} == {0, 1} and {r.confidence for r in lines if r.line_no == 1} == {-1.0}

    def failing(language):
        def engine(image, lang):
            raise ValueError("unreadable")

        return engine

    assert ocr.recognise(images.crops(rows), failing).collect() == []

    def namer(language):
        return lambda image, lang: [("250 DAHMX", 0.9)] if lang == "en" else [("가나다", 0.9)]

    record = json.loads(extract.as_json(extract.extract_images(rows, namer)).first().json)["extracted"]
    assert record["name"] == "DAHMX"
    record = json.loads(extract.as_json(extract.extract_images(rows, size_engine)).first().json)["extracted"]
    assert record["texts"]["banner"].startswith("en ")


def test_warm_engines():
    def factory(language):
        if language == "ch":
            raise OSError("no model")
        return size_engine(language)

    assert ocr.warm(factory, ["en", "ch", "korean"]) == ["en", "korean"]
    assert ocr.warm(ocr.recogniser("/nowhere"), ["en"]) == []  # the recognition library is not installed here


def test_warm_workers(spark):
    assert ocr.warm_workers(spark, only_english, ["en", "ch"]) == ["en"]


def test_base64_rows(spark):
    good = base64.b64encode(b"\xff\xfe\xfd picture").decode()
    texts = [good, good.rstrip("="), "data:image/png;base64," + good, " ".join(good), good.replace("/", "_").replace("+", "-"), "", None, "data:nothing", "***"]
    rows = inputs.decoded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "image_id int, image_b64 string")).orderBy("image_id").collect()
    assert [bytes(r.bytes) for r in rows[:5]] == [b"\xff\xfe\xfd picture"] * 5
    assert [r.status for r in rows] == [200] * 5 + [400] * 3 + [200] and bytes(rows[-1].bytes) == b""  # only foreign characters: no bytes, which are no image


class Shelf:
    """A session over made-up pages; it counts how often it is opened."""

    def __init__(self):
        self.open = False

    def __enter__(self):
        self.open = True
        return self

    def __exit__(self, *_):
        self.open = False

    def get(self, url):
        assert self.open
        if "broken" in url:
            raise OSError("refused")
        if "odd" in url:
            raise KeyError("odd")
        if "picture" in url:
            return 200, png(np.full((50, 60, 3), 200, "u1"))
        return (200, b"ok") if url.endswith("1") else (404, b"")


def test_fetching(spark):
    urls = ["http://x/1", "https://x/2", "http://broken", "ftp://x", None, "http://odd"]
    rows = spark.createDataFrame(list(enumerate(urls)), "image_id long, image_url string")
    got = lambda p: [(r.status, r.bytes and bytes(r.bytes)) for r in inputs.fetched(rows, Shelf, p).orderBy("image_id").collect()]
    assert got("current") == [(200, b"ok"), (500, None), (400, None), (422, None), (422, None), (500, None)]
    assert got("legacy") == [(200, b"ok"), (400, None), (500, None), (422, None), (422, None), (500, None)]


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image, filters=(0, 1, 2, 3, 4), colour=None, palette=None, depth=8):
    """A PNG of an RGB(A), grey or palette array, its rows filtered in turn by all filters, written plainly."""
    h, w = image.shape[:2]
    samples = image.reshape(h, w, -1)
    bpp, rows = samples.shape[2], samples.reshape(h, -1).astype(int)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[bpp] if colour is None else colour
    out = b""
    for y in range(h):
        kind, line = filters[y % len(filters)], []
        for i in range(rows.shape[1]):
            a = rows[y, i - bpp] if i >= bpp else 0
            b = rows[y - 1, i] if y else 0
            c = rows[y - 1, i - bpp] if y and i >= bpp else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((rows[y, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += bytes([kind, *line])
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def jvm_picture(spark, image, kind):
    """The picture written in another format by the JVM."""
    jvm = spark._jvm
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png(image))))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(source, kind, out)
    return bytes(out.toByteArray())


def interlaced(rgb):
    """An interlaced PNG, its seven passes written plainly."""
    h, w = rgb.shape[:2]
    rows = b"".join(b"\0" + part[y].tobytes() for x0, y0, dx, dy in pictures.PASSES if (part := rgb[y0::dy, x0::dx]).size for y in range(len(part)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def shown(spark, bodies):
    """(status, BGR array or None) of each body, decoded as staged files."""
    rows = spark.createDataFrame([(f"id {i}", 200, None, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "image_id string, status int, detail string, bytes binary")
    told, found = pictures.of_bodies(rows)
    held = {r.image_id: images.three_channels(np.frombuffer(r.data, "u1").reshape(r.height, r.width, r.channels)) for r in found.collect()}
    return [(r.status, held.get(r.picture)) for r in sorted(told.collect(), key=lambda r: int(r.image_id[3:]))], len(held)


def test_decoding_pictures(spark):
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (11, 7, 3)).astype("u1")
    rgba = np.concatenate([rgb, np.full((11, 7, 1), 255, "u1")], axis=2)
    palette = rng.integers(0, 256, (16, 3)).astype("u1")
    index = rng.integers(0, 16, (11, 7, 1)).astype("u1")
    smooth = np.tile(np.linspace(0, 250, 64).astype("u1")[:, None, None], (1, 64, 3))
    noise = rng.integers(0, 256, (64, 64, 3)).astype("u1")
    jpeg, rough = jvm_picture(spark, smooth, "jpg"), jvm_picture(spark, noise, "jpg")
    bodies = [
        png(rgb), png(rgba), png(rgb[..., :1]), png(index, colour=3, palette=palette), interlaced(rgb), jvm_picture(spark, rgb, "bmp"), jvm_picture(spark, rgb, "tiff"),
        jvm_picture(spark, np.tile(palette[:1], (5, 6, 1)).reshape(5, 6, 3), "gif"), jpeg, rough[: len(rough) * 3 // 4], png(noise)[:6000], interlaced(noise)[:6000], png(rgb)[:-12],
        b"", None, b"GIF89a", b"\x89PNG\r\n\x1a\n", b"no picture", png(rgb), rough,
    ]
    got, files = shown(spark, bodies)
    bgr = rgb[..., ::-1]
    for i in (0, 1, 4, 5, 6, 12, 18):
        assert got[i][0] == 200 and (got[i][1] == bgr).all(), i
    assert (got[2][1] == np.repeat(rgb[..., :1], 3, axis=2)).all() and (got[3][1] == palette[index[..., 0]][..., ::-1]).all() and (got[7][1] == palette[0, ::-1]).all()
    assert np.abs(got[8][1].astype(int) - smooth).max() < 12 and got[9][0] == 200
    assert (got[9][1][:16] == got[19][1][:16]).all() and not (got[9][1][48:] == got[19][1][48:]).all()
    assert (got[10][1][:20] == noise[:20, :, ::-1]).all() and not got[10][1][50:].any()  # rows that are there, black below
    assert got[11][0] == 200 and got[11][1].shape == (64, 64, 3) and (got[11][1][::8, ::8] == noise[::8, ::8, ::-1]).all()
    assert [x for x, _ in got[13:18]] == [400] * 5 and files == 14  # equal bodies are one picture


def test_mending_leaves_other_bodies_alone():
    whole = png(np.zeros((3, 3, 3), "u1"))
    for body in (whole, b"", b"\xff\xd8 jpeg", b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"x"), whole[:20]):
        assert pictures.mended(body) == body
    huge = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0"))
    assert pictures.mended(huge) == huge


def reader(language):
    """Reads a name at the bottom left and a code at the top left of a light picture."""
    def engine(image, lang):
        h, w = image.shape[:2]
        return [[[[[0, 0]], ("250 DAHMX" if w > 2 * h else "MAP CODE: A1B2C3", 0.9)]]] if lang == "en" else []

    return engine


def only_english(language):
    if language != "en":
        raise OSError("no model")
    return reader(language)


def no_engine(language):
    raise OSError("no model")


def test_from_base64_to_records(spark):
    text = lambda x: base64.b64encode(x).decode()
    image = np.full((120, 160, 3), 200, "u1")
    texts = {1: text(png(image)), 2: "data:image/png;base64," + text(png(image[..., :1])), 3: text(png(np.dstack([image, image[..., :1]]))), 4: text(b"no picture"), 5: "***", 6: None, 7: ""}
    rows = spark.createDataFrame(list(texts.items()), "image_id long, image_b64 string")
    got = {r.image_id: r for r in requests.answers(rows, reader).collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 200, 3: 200, 4: 400, 5: 400, 6: 400, 7: 400}
    assert len({got[k].json for k in (1, 2, 3)}) == 1 and '"code":"A1B2C3"' in got[1].json and all(got[k].json is None and got[k].detail for k in (4, 5, 6, 7))


def test_missing_engines_by_profile(spark):
    rows = spark.createDataFrame([(1, "http://x/picture"), (2, "http://x/2"), (3, "http://broken"), (4, "http://x/1")], "image_id long, image_url string")
    got = lambda f, p: [r.status for r in requests.answers(rows, f, p, Shelf).orderBy("image_id").collect()]
    assert got(reader, "current") == [200, 500, 400, 500] and got(reader, "legacy") == [200, 400, 500, 400]
    assert got(only_english, "current") == [503, 500, 400, 500] and got(only_english, "legacy") == [200, 400, 500, 400]
    assert got(no_engine, "current") == got(no_engine, "legacy") == [503] * 4


def test_rows_that_hold_no_image(spark):
    good = solid((200, 200, 200), 40, 60)
    rows = [(1, 40, 60, 3, bytearray(good.tobytes())), (2, 40, 60, 1, bytearray(good[..., 0].tobytes())), (3, -1, -1, -1, bytearray()), (4, 40, 60, 3, None), (5, 40, 60, 3, bytearray(b"short")), (6, None, None, None, None)]
    images_ = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary")
    got = {r.image_id: json.loads(r.json)["extracted"] for r in extract.as_json(extract.extract_images(images_, size_engine)).collect()}
    assert got[1] == got[2] and got[1]["texts"]["banner"] and all(set(got[k]["texts"].values()) == {""} for k in (3, 4, 5, 6))


def test_engines_are_told_apart_by_what_they_hold():
    def factory(word):
        return lambda language: lambda image, lang: [(word, 1.0)]

    one, two = (ocr.engine_for(factory(w), "en")(None, "en") for w in ("one", "two"))
    assert one == [("one", 1.0)] and two == [("two", 1.0)]
    assert ocr.engine_name(factory("one")) != ocr.engine_name(factory("two"))


def test_folder_to_records(spark, tmp_path):
    """A folder of pictures of any format goes to JSON with its paths."""
    image = np.full((120, 160, 3), 200, "u1")
    (tmp_path / "sub dir").mkdir()
    for name, body in {
        "a+b.png": png(image), "sub dir/ünï %20.jpg": jvm_picture(spark, image, "jpg"), "cut.png": png(np.random.default_rng(0).integers(180, 256, (120, 160, 3)).astype("u1"))[:20_000],
        "laced.png": interlaced(image), "bad.png": b"broken", "empty.gif": b"", "same.bin": png(image),
    }.items():
        (tmp_path / name).write_bytes(body)
    got = {r.image_id: r for r in requests.folder_answers(spark, str(tmp_path), reader).collect()}
    at = lambda name: got[f"file:{tmp_path}/{name}"]
    assert len(got) == 6  # Spark's file sources pass over files without bytes
    for name in ("a+b.png", "sub dir/ünï %20.jpg", "laced.png", "same.bin", "cut.png"):
        assert at(name).status == 200 and '"code":"A1B2C3"' in at(name).json, name
    assert [(at(n).status, at(n).json) for n in ("bad.png",)] == [(400, None)]
    assert {r.status for r in requests.folder_answers(spark, str(tmp_path), no_engine).collect()} == {503}


def test_string_ids_through_every_schema(spark):
    image = solid((200, 200, 200), 40, 60)
    rows = spark.createDataFrame([("one/ü", 40, 60, 3, bytearray(image.tobytes()))], "image_id string, height int, width int, channels int, data binary")
    lines = ocr.recognise(images.crops(rows), size_engine)
    assert dict(lines.dtypes)["image_id"] == "string" and {r.image_id for r in lines.collect()} == {"one/ü"}
    assert [r.image_id for r in extract.as_json(extract.extract_images(rows, size_engine)).collect()] == ["one/ü"]


class Grouped:
    """An engine that takes several crops, and fails on a call that holds a black one two pixels high."""

    calls = []

    def __init__(self, language):
        self.language = language

    def many(self, crops, language):
        Grouped.calls.append(len(crops))
        if any(not c.any() and c.shape[0] == 2 for c in crops):
            raise ValueError("black")
        return [[(f"{language} {c.shape[1]}x{c.shape[0]}", 0.5)] for c in crops]


def test_groups_of_crops(monkeypatch):
    """One call for a group; where it fails, a failing crop costs itself alone."""
    Grouped.calls = []
    crops = [np.full((2, 3 + i, 3), 9, "u1") for i in range(4)]
    assert ocr.answers_of(Grouped("en"), crops, "en") == [[(f"en {3 + i}x2", 0.5)] for i in range(4)] and Grouped.calls == [4]
    crops[2] = np.zeros((2, 5, 3), "u1")
    assert ocr.answers_of(Grouped("en"), crops, "en") == [[("en 3x2", 0.5)], [("en 4x2", 0.5)], [], [("en 6x2", 0.5)]] and Grouped.calls[1:] == [4, 1, 1, 1, 1]


@pytest.mark.parametrize("size", [ocr.GROUP_BYTES, 1])
def test_grouped_lines_are_those_of_single_calls(spark, monkeypatch, size):
    monkeypatch.setattr(ocr, "GROUP_BYTES", size)
    image = solid((200, 200, 200), 40, 60)
    rows = spark.createDataFrame([(k, 40, 60, 3, bytearray(image.tobytes())) for k in range(5)], "image_id long, height int, width int, channels int, data binary")
    single = lambda language: lambda x, lang: [(f"{lang} {x.shape[1]}x{x.shape[0]}", 0.5)]
    want = sorted(map(tuple, ocr.recognise(images.crops(rows), single).collect()))
    assert sorted(map(tuple, ocr.recognise(images.crops(rows), Grouped).collect())) == want and len(want) == 5 * 24


def late_factory(folder, fails):
    """Builds every engine while warming up, and not ``fails`` in a worker that has to build it again."""

    def factory(language):
        import os

        if language == fails and os.path.exists(f"{folder}/warmed"):
            raise OSError("gone")
        return reader(language) if language == "en" else (lambda image, lang: [("가나다", 0.9)])

    return factory


@pytest.mark.parametrize("fails,statuses", [("korean", {"current": 503, "legacy": 200}), ("en", {"current": 503, "legacy": 503})])
def test_a_worker_that_cannot_build_an_engine_later(spark, tmp_path, monkeypatch, fails, statuses):
    """Its images get the profile's status, and no job fails."""
    plain = np.full((120, 160, 3), 200, "u1")
    rows = spark.createDataFrame([(1, base64.b64encode(png(plain)).decode()), (2, "***")], "image_id long, image_b64 string")
    monkeypatch.setattr(ocr, "warm_workers", lambda spark_, factory, languages, name=None: languages)
    (tmp_path / "warmed").touch()

    def nameless(language):
        engine = late_factory(str(tmp_path), fails)(language)
        return (lambda image, lang: [("MAP CODE: A1B2C3", 0.9)]) if language == "en" else engine

    for profile, status in statuses.items():
        got = {r.image_id: r for r in requests.answers(rows, nameless, profile, engines=f"{fails} {profile}").collect()}
        assert (got[1].status, got[2].status) == (status, 400) and (got[1].json is None) == (status == 503)
        assert status == 200 or fails in got[1].detail


def test_lenient_base64(spark):
    """What a tolerant decoder reads, over texts with foreign characters and padding in odd places."""
    rng = np.random.default_rng(7)
    letters = np.array(list("AbZ09+/==*~ \n"))
    texts = ["YWJj*ZGVm", "YWJjZA==YWJj", "YW=JjZA==", "Y=W=Jj", "YWJjZ", "====", "", "YQ", "YQ=*=", "YWI=c", "Y", "YW*", "YWJjé"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(600)]

    def plain(text):
        text = "".join(text.split()).replace("-", "+").replace("_", "/")
        text += "=" * (-len(text) % 4)
        try:
            return base64.b64decode(text)
        except (ValueError, binascii.Error):
            return None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = df.select("i", inputs.lenient_base64(inputs.padded_base64(inputs.F.col("x"))).alias("b")).orderBy("i").collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [plain(t) for t in texts]
    assert bytes(got[0].b) == b"abcdef"


def serve(tmp_path, handler):
    import http.server
    import threading

    class Pages(http.server.BaseHTTPRequestHandler):
        log_message = lambda *_: None

        def do_GET(self):
            handler(self)

    class Server(http.server.ThreadingHTTPServer):
        request_queue_size = 256

    server = Server(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def say(page, status, body):
    page.send_response(status)
    page.send_header("Content-Length", str(len(body)))
    page.end_headers()
    page.wfile.write(body)


def test_addresses_are_asked_for_together(spark, tmp_path):
    """200 addresses of a slow server take a tenth of the time of one after another; one that hangs, one too large, passing troubles."""
    seen = {}

    def handler(page):
        n = seen[page.path] = seen.get(page.path, 0) + 1
        if page.path == "/hang":
            time.sleep(6)
        elif page.path == "/large":
            say(page, 200, b"x" * 100_000)
        elif page.path == "/busy":
            say(page, 503 if n < 3 else 200, b"at last")
        elif page.path == "/never":
            say(page, 503, b"")
        else:
            time.sleep(0.1)
            say(page, 200, page.path.encode())

    server, at = serve(tmp_path, handler)
    urls = [f"{at}/{i}" for i in range(200)]
    urls[50:50] = [f"{at}/hang", f"{at}/large", f"{at}/busy", f"{at}/never"]
    rows = spark.createDataFrame([(f"k{i}", u) for i, u in enumerate(urls)], "image_id string, image_url string").coalesce(1)
    session = lambda: inputs.HttpSession(timeout=0.7, deadline=2, most=50_000)
    inputs.fetched(rows.limit(1), session).collect()
    began = time.perf_counter()
    got = inputs.fetched(rows, session, at_once=40).collect()
    took = time.perf_counter() - began
    server.shutdown()
    assert [r.image_id for r in got] == [f"k{i}" for i in range(204)]  # in order
    assert [(r.status, r.bytes and bytes(r.bytes)) for r in got[50:54]] == [(400, None), (500, None), (200, b"at last"), (500, None)]
    assert "50000" in got[51].detail and seen["/busy"] == 3 and seen["/large"] == 1
    rest = got[:50] + got[54:]
    assert all(r.status == 200 for r in rest) and [bytes(r.bytes) for r in rest] == [f"/{i}".encode() for i in range(200)]
    assert took < 20.0 / 10 + 4, took  # 20 s one after another, beside the attempts at the one that hangs


def test_a_trickling_answer_ends_at_its_deadline(tmp_path):
    def handler(page):
        page.send_response(200)
        page.end_headers()
        for _ in range(40):
            page.wfile.write(b"x")
            page.wfile.flush()
            time.sleep(0.1)

    server, at = serve(tmp_path, handler)
    began = time.perf_counter()
    with inputs.HttpSession(timeout=1, deadline=0.5) as s, pytest.raises(TimeoutError):
        s.get(at)
    assert time.perf_counter() - began < 2
    server.shutdown()


def test_default_session(tmp_path):
    import http.server
    import threading

    class Pages(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path))

        log_message = lambda *_: None

    (tmp_path / "x").write_bytes(b"page")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with inputs.HttpSession() as s:
        at = f"http://127.0.0.1:{server.server_port}"
        assert s.get(f"{at}/x") == (200, b"page") and s.get(f"{at}/y")[0] == 404
    server.shutdown()


def test_status_and_models(spark, tmp_path, caplog):
    (tmp_path / "det/en/en_PP-OCRv3_det_infer").mkdir(parents=True)
    assert inputs.model_folders("en", str(tmp_path))[1] is None and inputs.model_folders("en", str(tmp_path))[0] and inputs.model_folders("xx", "/") == (None, None)
    assert inputs.model_catalog(spark, str(tmp_path)).count() == 4
    with caplog.at_level("INFO"):
        inputs.log_model_folders(str(tmp_path))
    assert len(caplog.messages) == 4
    assert ocr.engine_status(spark, ["korean", "en"]).first().models == ["en", "korean"]
    assert ocr.engine_status(spark, ["korean", "en"], legacy=True).first().models == ["korean", "en"]


LINES = "image_id long, call_no int, line_no int, text string, confidence double"


def watched(spark, tmp_path, part, schema=LINES, **how):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = watch_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), **how)
    query.awaitTermination(120)
    assert query.exception() is None
    return [p for p in query.recentProgress if p["numInputRows"]]


def names(spark, tmp_path, kind="long"):
    return {r.image_id: (v["name"], v["code"]) for r in latest(spark, str(tmp_path / "out"), kind).collect() for v in [json.loads(r.json)["extracted"]]}


def test_watching_a_folder(spark, tmp_path):
    """Lines of an image come in several batches, over restarts; a batch touches the state of its own images alone."""
    many = [(k, 4, 0, f"250 DAHMX{k}", 0.9) for k in range(50)]
    watched(spark, tmp_path, many)
    before = spark.read.parquet(str(tmp_path / "out")).agg({"batch": "max"}).first()[0]
    progress = watched(spark, tmp_path, [(1, 5, 0, "MAP CODE: A1B2C3", None), (77, 4, 0, "x NAME2", 0.9)])
    (state,) = progress[-1]["stateOperators"]
    assert (state["numRowsUpdated"], state["numRowsTotal"]) == (2, 51)
    got = names(spark, tmp_path)
    assert got[1] == ("DAHMX1", "A1B2C3") and got[77] == ("NAME2", None) and got[2] == ("DAHMX2", None) and len(got) == 51
    again = spark.read.parquet(str(tmp_path / "out")).where(f"batch > {before}").collect()
    assert sorted(r.image_id for r in again) == [1, 77]  # no other image was made again
    watched(spark, tmp_path, [(1, 4, 0, "250 OTHER", 0.9)])  # the same place again: the last one counts
    assert names(spark, tmp_path)[1] == ("OTHER", "A1B2C3")


def test_late_lines_after_the_state_has_gone(spark, tmp_path):
    """A line after the timeout makes a smaller record, which does not replace the whole one; ids are strings here."""
    schema = LINES.replace("long", "string", 1)
    for part in ([("a", 4, 0, "250 DAHMX", 0.9), ("a", 5, 0, "MAP CODE: A1B2C3", 0.9)], [("b", 4, 0, "250 BBBB", 0.9)], [("a", 5, 1, "LATE9", 0.9)]):
        progress = watched(spark, tmp_path, part, schema, idle=1, kind="string")
        time.sleep(0.05)
    assert names(spark, tmp_path, "string") == {"a": ("DAHMX", "A1B2C3"), "b": ("BBBB", None)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_several_batches_of_one_run(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, 4 + k, 0, ["250 DAHMX", "MAP CODE: A1B2C3", "junk"][k], 0.9)], LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watched(spark, tmp_path, [(2, 4, 0, "250 OTHER", 0.9)], batch_files=1)
    assert spark.read.parquet(str(tmp_path / "out")).where("lines > 0").select("batch").distinct().count() == 4 and names(spark, tmp_path) == {1: ("DAHMX", "A1B2C3"), 2: ("OTHER", None)}
