"""Media columns: a data source over archives whose members are read by offset."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import sys
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, tune

#: Bytes after which a writer begins another archive, and bytes of one planned range.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 8 << 20
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
#: Ranges that are planned, at most.
MOST_RANGES = 50_000
#: A payload is padded to a multiple of this.
UNIT = 64
#: Fixed values of the PNG format.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the ZIP format: a local header's mark and length.
LOCAL_MARK, LOCAL_BYTES = b"PK\x03\x04", 30


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of UNIT."""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def image_of(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, which are the payload's bytes. Rows are as
    long as they can be with at most 65,536 samples."""
    units = len(payload) // UNIT
    width = UNIT * next(k for k in range(min(units, 1024), 0, -1) if units % k == 0)
    rows = b"".join(b"\0" + payload[i : i + width] for i in range(0, len(payload), width))
    head = struct.pack(">IIBBBBB", width, len(payload) // width, 8, 0, 0, 0, 0)
    return PNG_MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 6)) + _chunk(b"IEND", b"")


def samples_of(image: bytes) -> bytes:
    """The samples of such a PNG; its checksums are verified."""
    if image[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = zlib.decompress(b"".join(data))
    if len(rows) != height * (width + 1) or any(rows[i] for i in range(0, len(rows), width + 1)):
        raise ValueError("unexpected rows")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _bytes(uri: str) -> bytes:
    files, path = _files(uri)
    with files.open_input_stream(path) as source:
        return source.read()


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Store every text of ``docs`` as an image in uncompressed zip archives.

    Each attempt of a task writes archives, and a list of them, under names of
    its own. The driver learns only the lists of successful attempts and their
    sizes, a row a task, and writes them to an index, whose path is returned;
    what a lost executor leaves behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        done: list[tuple[str, int]] = []
        held, archive, members = io.BytesIO(), None, 0

        def close() -> None:
            nonlocal held, archive, members
            if archive is None:
                return
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(held.getbuffer())
            done.append((name, held.getbuffer().nbytes))
            held, archive, members = io.BytesIO(), None, 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                data = text or b""
                archive.writestr(zipfile.ZipInfo(f"{members}_{'' if doc_id is None else doc_id}_{len(data)}.png"), image_of(padded(data)))
                members += 1
                if held.tell() >= archive_bytes:
                    close()
        close()
        if done:
            part = f"{uuid.uuid4().hex}.json"
            with files.open_output_stream(f"{root}/{part}") as out:
                out.write(json.dumps(done).encode())
            yield pa.RecordBatch.from_pydict({"part": [part], "bytes": [sum(n for _, n in done)]}, schema=pa.schema([("part", pa.string()), ("bytes", pa.int64())]))

    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    listed = [(r["part"], r["bytes"]) for r in rows.mapInArrow(run, "part string, bytes long").collect()]  # a row a task
    with files.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(sorted(listed)).encode())
    return f"{folder}/index.json"


class MediaRange(InputPartition):
    """Ranges of bytes in lists of archives: the members whose local headers begin
    there, if a list's archives stood one behind the other."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def read_member(source, info: zipfile.ZipInfo) -> bytes:
    """One stored member, found by its offset alone and checked by its CRC."""
    source.seek(info.header_offset)
    head = source.read(LOCAL_BYTES)
    if head[:4] != LOCAL_MARK:
        raise OSError(f"no member at {info.header_offset}")
    name_bytes, extra_bytes = struct.unpack_from("<HH", head, 26)
    source.seek(info.header_offset + LOCAL_BYTES + name_bytes + extra_bytes)
    data = source.read(info.file_size)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member {info.filename} is damaged")
    return bytes(data)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index = options["index"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def again(self, fetch):
        """What ``fetch`` gives, by as many attempts as are allowed."""
        for attempt in range(1, self.attempts + 1):
            try:
                return fetch()
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(0.1 * attempt)

    def partitions(self) -> list[MediaRange]:
        """Ranges of equal size, from the index alone: archives are listed by the
        tasks that read them. Ranges grow where they would be more than MOST_RANGES."""
        listed = json.loads(self.again(lambda: _bytes(self.index)))
        size = max(1, self.range_bytes, -(-sum(n for _, n in listed) // MOST_RANGES))
        out, pieces, room = [], [], size
        for part, end in listed:
            low = 0
            while low < end:
                high = min(end, low + room)
                pieces.append((part, low, high))
                room, low = room - (high - low), high
                if not room:
                    out.append(MediaRange(pieces))
                    pieces, room = [], size
        return out + [MediaRange(pieces)] if pieces or not out else out

    def read(self, partition: MediaRange) -> Iterator[pa.RecordBatch]:
        folder = self.index.rpartition("/")[0]
        for part, low, high in partition.pieces:
            start = 0
            for name, size in json.loads(self.again(lambda: _bytes(f"{folder}/{part}"))):
                if low < start + size and start < high:
                    yield from self.members(f"{folder}/{name}", low - start, high - start)
                start += size

    def members(self, uri: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Members of an archive by the range of their offsets, each retried alone."""
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        files, path = _files(uri)

        def directory() -> list[zipfile.ZipInfo]:
            with zipfile.ZipFile(files.open_input_file(path)) as archive:
                return sorted((i for i in archive.infolist() if low <= i.header_offset < high), key=lambda i: i.header_offset)

        found = self.again(directory)
        source = None

        def fetch(info: zipfile.ZipInfo) -> bytes:
            nonlocal source
            if source is None:
                source = files.open_input_file(path)
            try:
                return read_member(source, info)
            except OSError:
                source = None  # opened anew
                raise

        out: dict[str, list] = {f.name: [] for f in schema}
        held = 0
        for info in found:
            media = self.again(lambda: fetch(info))
            _, doc_id, n_bytes = info.filename.removesuffix(".png").split("_")
            out["doc_id"].append(int(doc_id) if doc_id else None)
            out["n_bytes"].append(int(n_bytes))
            out["media"].append(media)
            held += len(media)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out, held = {f.name: [] for f in schema}, 0
        if out["media"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)


class MediaSource(DataSource):
    """``spark.read.format("media_archives").option("index", path).load()``

    Options: ``index``, ``rangeBytes`` and ``attempts``. Columns: ``doc_id``,
    ``n_bytes`` (before padding) and ``media`` (the stored image).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, index: str, **options) -> DataFrame:
    """The members of the archives behind an index."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(MediaSource)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    reader = spark.read.format("media_archives").option("index", index)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def feature(samples: bytes) -> str:
    """Mean, spread, entropy in bits and mean step of the samples, to six digits."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    held = share[share > 0]
    steps = np.abs(np.diff(x.astype(np.int16)))
    return f"mean={x.mean():.6f};spread={x.std():.6f};entropy={-(held * np.log2(held)).sum() + 0.0:.6f};step={steps.mean():.6f}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes read back."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = samples_of(image)
                rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Store texts as images in archives, read them back by byte ranges, compute features.

    Writes at once, to ``folder`` or to a new one in the shared folder; the
    result reads lazily. Archives are filled in memory up to ``archive_bytes``
    and one member, and read member by member.

    A null text counts as empty and is 64 bytes 0; a null id stays null; a long
    text is one member, however long; equal texts give equal values, whatever
    their archive; repeated rows give repeated
    results; columns beside ``doc_id`` and ``text`` are ignored; an empty table
    gives an empty result.
    """
    spark = tune(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/corvane-media-{uuid.uuid4().hex}"
    return features(read_archives(spark, write_archives(docs, folder, archive_bytes), rangeBytes=range_bytes))
