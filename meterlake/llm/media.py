"""Media columns: texts stored as PNG images in tar archives, and a Spark data source that reads them.

``write_archives`` lets each task write one tar archive of lossless 8-bit RGB images (64 pixels, 192 bytes
a row) into a folder, with an index beside it (Parquet: member offsets in order, and the ids of the rows, which may be of any length
and text). ``MediaArchive`` (format name ``media_archive``) plans byte ranges over a folder of such archives, reads a range's members
one by one from one open file and of the index what the range needs, streams them as Arrow batches, and tries a failed member
again at its offset, with the file opened anew, without starting over.

Defined cases: what isn't UTF-8 counts as U+FFFD; null text is the empty text (one row of blanks); null ids become null again, others come
back as they were; repeated rows are members of their own; a very long text is one image (a task holds it whole, others of its batch
aside); an empty table makes no archive and an empty result; columns other than id and text are not read, whatever their names; a member
that stays unreadable comes out with its error and null bytes, or raises if ``mode`` is ``failfast``; without an index ids are null.
"""

from __future__ import annotations

import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, valid_text

ROW_BYTES = 192
#: Decoded bytes that are handed on at once.
_DECODED = 8 << 20
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, member string, member_offset bigint, member_id string, media binary, error string"
_INDEX = pa.schema([("offset", pa.int64()), ("bytes", pa.int64()), ("id", pa.string())])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: bytes) -> bytes:
    """The text's bytes and blanks up to a positive multiple of a row."""
    return text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))


def encode_png(text: bytes, level: int = 6) -> bytes:
    """The text's payload as 8-bit RGB, 64 pixels wide, rows unfiltered; a text chunk has the length without padding."""
    payload = payload_of(text)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    note = _chunk(b"tEXt", b"bytes\0%d" % len(text))
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> tuple[bytes, int]:
    """Samples, and the length without padding, of an image as ``encode_png`` makes them; ValueError for anything else."""
    if png[:8] != PNG_SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, shape, length = 8, [], None, None
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged chunk at {at}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            length = int(data[6:])
        at += 12 + n
    if shape is None or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not an 8-bit RGB image")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] * 3 + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if length is None else length


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> list[str]:
    """Writes one archive for each input partition that has rows; their names. A task that runs again
    replaces its own archive as a whole, by rename."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.tar"
        temp = f"{top}/_{name}-{uuid.uuid4().hex}"
        tar, index, at, n = None, [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if tar is None:
                    store.create_dir(top, recursive=True)
                    tar = store.open_output_stream(temp)
                png = encode_png((text.as_py() or "").encode("utf-8"), level)
                info = tarfile.TarInfo(f"{n:09d}.png")
                info.size = len(png)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                tar.write(head + png + bytes(-len(png) % 512))
                index.append((at, len(png), doc))
                at += len(head) + len(png) + -len(png) % 512
                n += 1
        if tar is not None:
            tar.write(bytes(1024))
            tar.close()
            with store.open_output_stream(f"{temp}.idx") as f:
                columns = [pa.array(c, t.type) for c, t in zip(zip(*index, strict=True), _INDEX, strict=True)]
                pq.write_table(pa.Table.from_arrays(columns, schema=_INDEX), f, row_group_size=16_384)
            store.move(f"{temp}.idx", f"{top}/{name}.idx")
            store.move(temp, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    kept = docs.select(F.col(id_col).cast("string"), valid_text(F.col(text_col)))
    return sorted(r.name for r in kept.mapInArrow(run, "name string").collect())  # one short row a partition


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("rangebytes", 8 << 20))
        self.tries, self.mode = int(options.get("tries", 3)), options.get("mode", "permissive")
        self.batch_bytes, self.wait = int(options.get("batchbytes", 4 << 20)), float(options.get("wait", 0.2))

    def partitions(self) -> list[InputPartition]:
        store, top = _open(self.folder)
        found = store.get_file_info(pafs.FileSelector(top, allow_not_found=True))
        tars = sorted((f.path, f.size) for f in found if f.path.endswith(".tar") and not f.base_name.startswith("_"))
        plan = [_Range(p, a, min(a + self.range_bytes, size)) for p, size in tars for a in range(0, size, self.range_bytes)]
        return plan or [_Range("", 0, 0)]

    def offsets(self, store: pafs.FileSystem, part: _Range) -> Iterator[tuple[int, str | None]]:
        """(offset, id) of the members whose header starts in the range: from the index, else header by header."""
        index = f"{part.path}.idx"
        if store.get_file_info(index).type == pafs.FileType.File:
            inside = [("offset", ">=", part.start), ("offset", "<", part.end)]
            found = pq.read_table(index, filesystem=store, columns=["offset", "id"], filters=inside)
            yield from zip(found.column("offset").to_pylist(), found.column("id").to_pylist(), strict=True)
            return
        with store.open_input_file(part.path) as f:
            at = 0
            while at < part.end:
                f.seek(at)
                head = f.read(512)
                if len(head) < 512 or not head.strip(b"\0"):
                    return
                if at >= part.start:
                    yield at, None
                at += 512 + -(-tarfile.TarInfo.frombuf(head, "utf-8", "strict").size // 512) * 512

    def open(self, store: pafs.FileSystem, path: str) -> pa.NativeFile:
        return store.open_input_file(path)

    def member(self, f: pa.NativeFile, at: int) -> tuple[str, bytes]:
        f.seek(at)
        info = tarfile.TarInfo.frombuf(f.read(512), "utf-8", "strict")
        data = f.read(info.size)
        if len(data) < info.size:
            raise OSError(f"the archive ends inside the member at {at}")
        return info.name, data

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, top = _open(self.folder)
        archive, rows, held, f = part.path.rsplit("/", 1)[-1], [], 0, None
        for at, own in self.offsets(store, part):
            for k in range(self.tries):
                try:
                    f = f or self.open(store, part.path)
                    row = (archive, *self._row(f, at, own))
                    break
                except (OSError, tarfile.TarError) as e:
                    f = None  # the next try opens the file anew
                    if k + 1 == self.tries and self.mode == "failfast":
                        raise
                    row = (archive, None, at, own, None, f"{type(e).__name__}: {e}"[:300])
                    time.sleep(self.wait * k)
            rows.append(row)
            held += len(row[4] or b"")
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, f: pa.NativeFile, at: int, own: str | None) -> tuple:
        name, data = self.member(f, at)
        return name, at, own, data, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchive(DataSource):
    """Options: path, rangeBytes, batchBytes, tries, wait (seconds, grows with each try), mode."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Adds the decoded payload, its length without padding, and a feature string: image size, mean and largest sample, and the number
    of sample changes, all whole numbers of the decoded image (the mean in thousandths)."""

    names = [*media.columns, "payload", "n_bytes", "feature"]

    def features(png: bytes) -> tuple[bytes, int, str]:
        data, length = decode_png(png)
        x = np.frombuffer(data, np.uint8)
        return data, length, f"64x{len(x) // ROW_BYTES} mean={int(x.sum()) * 1000 // len(x)} max={x.max()} changes={np.count_nonzero(x[1:] != x[:-1])}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, held = 0, [], 0
            for k, png in enumerate(batch.column("media")):
                found.append(features(png.as_py()) if png.is_valid else (None, None, None))
                held += len(found[-1][0] or b"")
                if held >= _DECODED or k + 1 == batch.num_rows:  # by decoded bytes: a small image may be a large text
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, k + 1 - first).columns, *columns], names=names)
                    first, found, held = k + 1, [], 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{schema}, payload binary, n_bytes bigint, feature string")


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image, reads the archives back; rows (id, media, payload, feature, ...)."""
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, id_col=id_col, text_col=text_col)
    id_type = docs.schema[id_col].dataType
    media = read_archives(docs.sparkSession, folder, mode="failfast")
    return media_features(media).withColumn(id_col, F.col("member_id").cast(id_type))
