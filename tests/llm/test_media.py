from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from pathlib import Path

import pytest
from helpers import DATA
from hypothesis import given
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.errors import PySparkException

from quire.llm import media


@given(st.binary(max_size=1000))
def test_image_round_trip(payload):
    samples = media.pad(payload)
    assert len(samples) % 192 == 0 and len(samples) >= max(192, len(payload)) and samples[: len(payload)] == payload and set(samples[len(payload) :]) <= {32}
    assert media.decode_png(media.encode_png(samples)) == samples


def test_broken_images_are_noticed():
    good = media.encode_png(media.pad(b"abc"))
    for bad in (b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_query_round_trip(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = media.op3_media_columns(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        stored = media.encode_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.describe(payload))


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(200)], "doc_id long, text string").repartition(3)
    return media.write_media(docs, f"file://{tmp_path}/media", archive_bytes=4000)


def test_ranges_cover_every_member_once(spark, folder):
    for split in (1, 700, 10**9):
        rows = media.read_media(spark, folder, splitBytes=split).select("doc_id", "n_bytes").collect() if split > 1 else []
        assert not rows or sorted(r["doc_id"] for r in rows) == list(range(200))
    reader = media.MediaArchiveReader({"path": folder, "splitbytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 20 and all(len(p.ranges) == 1 and 0 < p.ranges[0].end - p.ranges[0].begin <= 700 for p in parts)


def test_tasks_are_bounded_and_still_read_everything(folder, monkeypatch):
    monkeypatch.setattr(media, "MOST_TASKS", 3)
    reader = media.MediaArchiveReader({"path": folder, "splitbytes": "50"})
    parts = reader.partitions()
    assert len(parts) <= 3
    assert sorted(r["doc_id"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == list(range(200))


def test_only_committed_archives_are_read(spark, folder, tmp_path):
    stray = io.BytesIO()
    with zipfile.ZipFile(stray, "w") as z:
        z.writestr("0/999/3.png", media.encode_png(media.pad(b"abc")))
    (tmp_path / "media/archives/stray.zip").write_bytes(stray.getvalue())
    assert media.read_media(spark, folder).count() == 200


def test_members_are_retried_by_offset(folder, monkeypatch):
    reader = media.MediaArchiveReader({"path": folder})
    tries, real = {}, media.read_member

    def flaky(files, path, offset, size):
        tries[path, offset] = tries.get((path, offset), 0) + 1
        if offset and tries[path, offset] == 1:
            raise OSError("lost connection")
        return real(files, path, offset, size)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == list(range(200))
    assert {n for (_, offset), n in tries.items()} == {1, 2}


def test_unreadable_members_fail_or_come_as_null(spark, folder, tmp_path):
    victim = next((tmp_path / "media/archives").glob("*.zip"))
    data = bytearray(victim.read_bytes())
    data[80] ^= 255
    victim.write_bytes(data)
    with pytest.raises(PySparkException, match="can't be read"):
        media.read_media(spark, folder, retries=0).collect()
    rows = media.read_media(spark, folder, retries=0, onError="null").collect()
    assert len(rows) == 200 and sum(r["media"] is None for r in rows) == 1
    assert media.media_features(media.read_media(spark, folder, retries=0, onError="null")).count() == 199


def test_batches_are_bounded(folder, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 500)
    reader = media.MediaArchiveReader({"path": folder})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 30 and sum(b.num_rows for b in batches) == 200


def test_messy_rows(spark, messy, no_docs, tmp_path):
    rows = media.media_features(media.read_media(spark, media.write_media(messy, f"file://{tmp_path}/a"))).collect()
    assert len(rows) == messy.count()
    assert {(r["n_bytes"], r["payload_bytes"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 192)}
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert media.media_features(media.read_media(spark, media.write_media(no_docs, f"file://{tmp_path}/b"))).count() == 0


def test_plain_paths_work(tmp_path):
    files, path = media._open(str(tmp_path))
    assert isinstance(files, fs.LocalFileSystem) and Path(path) == tmp_path
