from __future__ import annotations

import hashlib
import json
import zipfile
import zlib

import pytest

from corvane.llm import media_columns as media
from corvane.llm.media_columns import MediaReader, feature, image_of, media_columns, padded, read_archives, samples_of, write_archives

from .helpers import empty, odd


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4096, 64 * 1031, 64 * 2500, 1_000_001])
def test_image_round_trip(size):
    data = bytes(i * 31 % 251 for i in range(size))
    payload = padded(data)
    assert len(payload) % 64 == 0 and payload and payload[: len(data)] == data and not any(payload[len(data) :])
    assert samples_of(image_of(payload)) == payload


def test_odd_rows(spark):
    got = media_columns(odd(spark), archive_bytes=2000, range_bytes=300).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(padded((r.text or "").encode())).hexdigest()) for r in odd(spark).collect())
    assert sorted((str(r.doc_id), r.payload_sha256) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature))
        assert r.payload_bytes >= max(64, r.n_bytes)
    assert all(len(x) == 1 for x in by.values())
    none = next(r for r in got if r.doc_id == 4)
    assert none.n_bytes == 0 and none.tail_crc32 == zlib.crc32(bytes(64)) and none.feature == feature(bytes(64))


def test_ranges_cover_members_once(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text")
    manifest = write_archives(docs, str(tmp_path), archive_bytes=5000)
    for size in (1, 100, 10_000, 1 << 30):
        rows = read_archives(spark, manifest, rangeBytes=max(size, 500)).collect()
        assert sorted(r.doc_id for r in rows) == list(range(300))


def test_members_are_retried_alone(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(5):
            z.writestr(f"{i}_{i}_3.png", image_of(padded(b"abc")))
    tries = {}
    real = media.read_member

    def flaky(source, info):
        tries[info.filename] = tries.get(info.filename, 0) + 1
        if info.filename == "2_2_3.png" and tries[info.filename] < 3:
            raise OSError("lost")
        return real(source, info)

    monkeypatch.setattr(media, "read_member", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    reader = MediaReader({"index": str(tmp_path / "index.json")})
    ids = [i for b in reader.members(str(path), 0, 1 << 30) for i in b.column(0).to_pylist()]
    assert ids == [0, 1, 2, 3, 4] and tries["2_2_3.png"] == 3 and tries["1_1_3.png"] == 1


def test_damage_is_found(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0_0_3.png", image_of(padded(b"abc")))
    data = bytearray(path.read_bytes())
    data[60] ^= 1
    path.write_bytes(data)
    with pytest.raises(OSError):
        list(MediaReader({"index": "", "attempts": "1"}).members(str(path), 0, 1 << 30))


def test_opening_is_retried(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0_7_3.png", image_of(padded(b"abc")))
    (tmp_path / "part.json").write_text(json.dumps([["a.zip", path.stat().st_size]]))
    (tmp_path / "index.json").write_text(json.dumps([["part.json", path.stat().st_size]]))
    left = {"index.json": 2, "part.json": 2, "a.zip": 2}
    real = media._files

    def flaky(uri):
        name = uri.rpartition("/")[2]
        if left.get(name, 0):
            left[name] -= 1
            raise OSError("lost")
        return real(uri)

    class Files:
        def __init__(self, inner):
            self.inner, self.left = inner, 2

        def open_input_file(self, name):
            if self.left:
                self.left -= 1
                raise OSError("lost")
            return self.inner.open_input_file(name)

        def open_input_stream(self, name):
            return self.inner.open_input_stream(name)

    left["a.zip"] = 0
    monkeypatch.setattr(media, "_files", lambda uri: (Files(flaky(uri)[0]), flaky(uri)[1]))
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    reader = MediaReader({"index": str(tmp_path / "index.json")})
    (planned,) = reader.partitions()
    assert [b.column(0).to_pylist() for b in reader.read(planned)] == [[7]]


def test_ranges_are_packed(tmp_path, monkeypatch):
    (tmp_path / "index.json").write_text(json.dumps([[f"p{i}", 10 + i] for i in range(100)]))
    for size, most in ((25, 10**6), (1, 40), (10**9, 10)):
        monkeypatch.setattr(media, "MOST_RANGES", most)
        planned = MediaReader({"index": str(tmp_path / "index.json"), "rangebytes": str(size)}).partitions()
        sizes = [sum(high - low for _, low, high in p.pieces) for p in planned]
        assert len(planned) <= most and sum(sizes) == sum(10 + i for i in range(100)) and len(set(sizes[:-1])) <= 1
        assert [x for p in planned for part, low, high in p.pieces for x in ((part, k) for k in range(low, high))] == [(f"p{i}", k) for i in range(100) for k in range(10 + i)]

def test_empty(spark):
    assert media_columns(empty(spark)).collect() == []
