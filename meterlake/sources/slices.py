"""Log files in byte ranges, from where the last scan stopped.

A listing is joined to the cursors of what has been read; what is new of a file is cut into ranges, so that one huge file is the
work of many tasks. A range has the lines that begin in it; its reader goes on behind its end to finish the last one, never
past the size listed, and only as far as a line break: the open line of a file that is being written waits. Readers hold one
line and a block of bytes. ``.zst`` files can't be entered midway; one is read as a stream by one task, whole, if it changed.

``line_no`` is the byte at which a line begins (of the decompressed text): it rises down the file and is the same in any scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import _open, log_files

LINES = "path string, piece bigint, line_no bigint, next_offset bigint, text string"
CURSORS = "path string, size bigint, mtime bigint, offset bigint"
_LISTED = "root string, path string, size bigint, mtime bigint"
RANGE_BYTES = 64 << 20
_BLOCK = 1 << 20


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, size, mtime in nanoseconds) of the log files below the roots, each path once."""
    found = {}
    for root in roots:
        store, _ = _open(root)
        paths = [p for p, _ in log_files(root)]
        for info in store.get_file_info(paths) if paths else []:
            found.setdefault(info.path, (root, info.path, info.size, info.mtime_ns or 0))
    return spark.createDataFrame(sorted(found.values()), _LISTED)


def resume_at() -> Column:
    """Where to read on, of (size, mtime, known_size, known_mtime, offset): from the start if the file is new, is smaller than it was or
    than what was read of it, is older, or changed without a change of size; null if nothing changed."""
    grown = (F.col("size") >= F.col("known_size")) & (F.col("size") >= F.col("offset")) & (F.col("mtime") >= F.col("known_mtime"))
    same = (F.col("size") == F.col("known_size")) & (F.col("mtime") == F.col("known_mtime"))
    again = ~grown | (F.col("size") == F.col("known_size")) | F.col("path").endswith(".zst")
    return F.when(F.col("known_size").isNull(), F.lit(0).cast("bigint")).when(same, None).when(again, 0).otherwise(F.col("offset"))


def plan(listed: DataFrame, cursors: DataFrame | None) -> DataFrame:
    """The listing with ``start``: where to read on; files that haven't changed are left out."""
    known = listed.sparkSession.createDataFrame([], CURSORS) if cursors is None else cursors
    known = known.select("path", F.col("size").alias("known_size"), F.col("mtime").alias("known_mtime"), "offset")
    return listed.join(known, "path", "left").withColumn("start", resume_at()).filter("start IS NOT NULL").select("root", "path", "size", "mtime", "start")


def ranges(planned: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(root, path, piece, start, end, size): ranges of at most ``range_bytes`` of each file, numbered down the file."""
    whole = F.col("path").endswith(".zst")
    n = F.when(whole, 1).otherwise(F.greatest(F.ceil((F.col("size") - F.col("start")) / range_bytes), F.lit(1)))
    cut = planned.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("piece"))
    first = F.col("start") + F.col("piece") * range_bytes
    return cut.select("root", "path", "piece", first.alias("start"), F.least(first + range_bytes, F.col("size")).alias("end"), "size", (F.col("piece") == 0).alias("at_line"))


def plain_lines(store: pafs.FileSystem, path: str, start: int, end: int, size: int, at_line: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end)."""
    with store.open_input_file(path) as f:
        at = start if at_line else start - 1  # one byte before: whether it is a line break says if a line begins at the start
        f.seek(at)
        held, line_at, inside = [], at, at_line
        while at < size:
            block = f.read(min(_BLOCK, size - at))
            if not block:
                return
            at += len(block)
            parts = block.split(b"\n")
            for part in parts[:-1]:
                line = b"".join([*held, part])
                if inside:
                    yield line_at, line
                held, line_at, inside = [], line_at + len(line) + 1, True
                if line_at >= end:
                    return
            held.append(parts[-1])


def packed_lines(store: pafs.FileSystem, path: str) -> Iterator[tuple[int, bytes]]:
    import zstandard

    with store.open_input_stream(path, compression=None) as f:
        stream, held, at = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True), [], 0
        while block := stream.read(_BLOCK):
            parts = block.split(b"\n")
            for part in parts[:-1]:
                line, held = b"".join([*held, part]), []
                yield at, line
                at += len(line) + 1
            held.append(parts[-1])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in LINES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_ranges(cut: DataFrame, tasks: int | None = None) -> DataFrame:
    """The lines of ``ranges``; text that isn't UTF-8 is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                store, _ = _open(r["root"])
                packed = r["path"].endswith(".zst")
                found = packed_lines(store, r["path"]) if packed else plain_lines(store, r["path"], r["start"], r["end"], r["size"], r["at_line"])
                for at, line in found:
                    try:
                        text = line.decode("utf-8").removesuffix("\r")
                    except UnicodeDecodeError:
                        text = None
                    rows.append((r["path"], r["piece"], at, r["size"] if packed else at + len(line) + 1, text))
                    held += len(line)
                    if len(rows) >= 5000 or held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    # Ranges are dealt singly: each is a task's work, however few rows the plan has.
    n = tasks or max(1, min(cut.count(), 10_000))
    return cut.repartition(n, "path", "piece").mapInArrow(run, LINES)


def cursors_after(planned: DataFrame, lines: DataFrame) -> DataFrame:
    """Cursors of the planned files once their lines are read: behind the last finished line."""
    ends = lines.groupBy("path").agg(F.max("next_offset").alias("end"))
    return planned.join(ends, "path", "left").select("path", "size", "mtime", F.coalesce("end", "start").alias("offset"))
