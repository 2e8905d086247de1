"""Lines of append-only log files with their place, as a batch and as a streaming source.

A file's lines stay in order in one partition. Only finished lines come out: the text behind the last line break
waits for the next read. ``.zst`` files are read whole, as streams. Lines that aren't UTF-8 come out with null text.
For files too large for one task see ``slices``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, line_no bigint, byte_offset bigint, text string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def log_files(root: str, names: tuple[str, ...] = (".jsonl", ".jsonl.zst"), skip: tuple[str, ...] = ("history.jsonl",)) -> list[tuple[str, int]]:
    """(path, size) of the log files below a folder, or the file itself, each real path once."""
    store, top = _open(root)
    info = store.get_file_info(top)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = store.get_file_info(pafs.FileSelector(top, recursive=True))
    kept = {f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.endswith(names) and PurePosixPath(f.path).name not in skip}
    return sorted(kept.items())


def read_lines(root: str, path: str, start: int, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the finished lines in [start, end); the reader holds one line and a block of bytes."""
    from .slices import packed_lines, plain_lines

    store, _ = _open(root)
    size = store.get_file_info(path).size if end is None else end
    packed = path.endswith(".zst")
    found = (packed_lines(store, path) if start == 0 else ()) if packed else plain_lines(store, path, start, size, size, True)
    rows, held = [], 0
    for n, (at, line) in enumerate(found):
        try:
            text = line.decode("utf-8").removesuffix("\r")
        except UnicodeDecodeError:
            text = None
        rows.append((path, n, at, text))
        held += len(line)
        if len(rows) >= 5000 or held >= 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "line_no", "byte_offset", "text"])


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Batch(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        plan, seen = [], set()
        for root in self.roots:
            for path, _ in log_files(root):
                if path not in seen:
                    seen.add(path)
                    plan.append(_Slice(f"{root}\n{path}", 0, None))
        return plan or [_Slice("", 0, 0)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        if part.path:
            root, path = part.path.split("\n")
            yield from read_lines(root, path, part.start, part.end)


class _Stream(DataSourceStreamReader):
    """Offsets are {path: [bytes read, size, time of change]}; a file that shrank, or changed at the same size, is read again from its
    start. Only files that changed since the last look are opened to find their last line break."""

    def __init__(self, roots: list[str]):
        self.roots = roots
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        ends = {}
        for root in self.roots:
            store, _ = _open(root)
            paths = [p for p, _ in log_files(root)]
            for info in store.get_file_info(paths) if paths else []:
                was = self.known.get(info.path)
                same = was and was[1:] == [info.size, info.mtime_ns or 0]
                ends[info.path] = was if same else [self._finished(store, info.path, info.size), info.size, info.mtime_ns or 0]
        self.known = ends
        return {"files": json.dumps(ends, sort_keys=True)}

    @staticmethod
    def _finished(store: pafs.FileSystem, path: str, size: int) -> int:
        """Behind the last line break; looks back in growing steps."""
        if path.endswith(".zst"):
            return size
        back = min(size, 1 << 20)
        with store.open_input_file(path) as f:
            while True:
                f.seek(size - back)
                tail = f.read(min(back, 1 << 20))  # the part not looked at yet
                at = tail.rfind(b"\n")
                if at >= 0 or back == size:
                    return size - back + at + 1
                back = min(size, back + (1 << 20))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        plan = []
        for root in self.roots:
            for path, _ in log_files(root):
                (a, size, time), (b, new_size, new_time) = old.get(path, (0, 0, 0)), new.get(path, (0, 0, 0))
                again = b < a or new_size < size or (new_size == size and new_time != time)
                a = 0 if again or (path.endswith(".zst") and b != a) else a
                if b > a:
                    plan.append(_Slice(f"{root}\n{path}", a, b))
        return plan

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        root, path = part.path.split("\n")
        yield from read_lines(root, path, part.start, part.end)

    def commit(self, end: dict) -> None:
        pass


class AgentLines(DataSource):
    """Format ``agent_lines``; option ``path`` has one or more roots, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "agent_lines"

    def schema(self) -> str:
        return SCHEMA

    def _roots(self) -> list[str]:
        return [p for p in self.options["path"].split(",") if p]

    def reader(self, schema) -> _Batch:
        return _Batch(self._roots())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._roots())
