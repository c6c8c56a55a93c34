import numpy as np
import pytest
from hudlake.llm import records, shared, tokens


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n, dtype="u1").tobytes() for n in (0, 1, 8, 255, 256, 257, 512, 700, 3001)]
    assert records.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]


def test_frames_round_trip_and_damage_is_found():
    payloads = [b"", b"abc", b"x" * 1000]
    frames = records.frame(payloads)
    offsets = np.cumsum([0, *map(len, frames)])
    data = b"".join(frames)
    assert records.unframe(data, offsets) == payloads
    for at in (3, 9, len(data) - 900, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), offsets)


def test_payload_widths():
    for ids in ([], [1, 2, 65535], [65536, 5]):
        raw = np.array(ids, "<u4").tobytes()
        assert records.parse(records.payload(7, raw)) == (7, raw)
        assert records.parse(records.payload(None, raw)) == (None, raw)


def test_files_hold_all_ids_in_order(spark):
    texts = [(5, "five five"), (None, "no id"), (3, None), (9, ""), (7, "seven  double\n\n"), (7, "seven again"), (5, "five five"), (1, "long " * 9000)]
    docs = spark.createDataFrame([(k, t, 1, "a") for k, t in texts], "doc_id long, text string, start long, ids string")
    manifest = records.write(docs, shared.new_path(spark, "records"))
    got = sorted(records.read(manifest).collect(), key=lambda r: r.start)
    enc = tokens.Encoder().tokenizer
    keys = [k for k, _ in texts]
    assert [r.id for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    left, at = [(k, np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in texts], 0
    for r in got:
        left.remove((r.id, bytes(r.ids)))
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert not left
    # a shuffled reader fetches one record by its offset alone
    path = manifest.orderBy("shard").first().path
    folder, stem = records.open_folder(path)
    offsets = np.frombuffer(folder.open_input_file(f"{stem}.idx").read(), "<u8").astype("i8")
    with folder.open_input_file(f"{stem}.rec") as f:
        f.seek(int(offsets[-2]))
        assert len(records.unframe(f.read(), offsets[-2:] - offsets[-2])) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert records.read(records.write(docs, shared.new_path(spark, "records"))).collect() == []


def test_rows_that_repeat_are_split_over_shards(spark):
    """20,000 rows of one id and text: no shard holds more than a fair part, and the file order is still that of ids."""
    rows = spark.range(24_000, numPartitions=3).selectExpr("CASE WHEN id < 20000 THEN 5 ELSE id END AS doc_id", "CASE WHEN id < 20000 THEN 'same' ELSE 'other' END AS text")
    manifest = records.write(rows, shared.new_path(spark, "records"))
    sizes = [r.records for r in manifest.collect()]
    assert sum(sizes) == 24_000 and max(sizes) <= 3 * 24_000 / (records.CORE_SHARDS * spark.sparkContext.defaultParallelism)
    got = records.read(manifest).orderBy("start").collect()
    assert [r.id for r in got] == [5] * 20_000 + list(range(20_000, 24_000)) and [r.start for r in got] == list(range(0, 48_000, 2))


def test_number_of_shards_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(records, "SHARD_BYTES", 1)
    monkeypatch.setattr(records, "MOST_SHARDS", 40)
    rows = spark.range(100).selectExpr("id AS doc_id", "'text' AS text")
    assert records.shards(rows.selectExpr("doc_id AS k", "text AS t")) == 40
    manifest = records.write(rows, shared.new_path(spark, "records"))
    assert manifest.count() <= 40 and records.read(manifest).count() == 100
