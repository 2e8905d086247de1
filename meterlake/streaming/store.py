"""Tables that grow together: one commit takes in the rows of several tables and the cursors of what has been read.

A store is a folder. ``commits/<number>.json`` says of the ledger after that commit which folder holds each bucket of each
table, and has its small state (cursors, counters, the fencing number). Rows are dealt to buckets by a hash of their key. What
a writer changes it first writes beside what there is: of a table only the buckets that the change touches; the others keep
the folder they have. Then it creates the next commit file, which fails if there is one already. So a reader sees the tables
as of one commit, a writer that is killed before that leaves nothing but files no commit names, and of two writers of the
same commit one wins.

A writer takes the next fencing number with a commit of its own; one that holds an older number can't commit any more.

Commit files are created by linking on local disks and by renaming without overwriting elsewhere; a file system whose rename
replaces the target needs another way.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which all executors see; only a local session may do without."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = f"file://{tempfile.gettempdir()}/ledger-{os.getuid()}"
    return place.rstrip("/")


class Conflict(RuntimeError):
    """Another writer has made the commit."""


class Fenced(RuntimeError):
    """Another writer has taken over."""


@dataclass
class Commit:
    """What a commit file holds. ``tables``: by name its schema, number of buckets, key and folder of each bucket."""

    number: int = 0
    fence: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    state: dict[str, object] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self.files.makeQualified(path).toString().rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        place = self._path(name)
        return [f.getPath().getName() for f in self.files.listStatus(place)] if self.files.exists(place) else []

    def _read_text(self, name: str) -> str:
        stream = self.files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Writes the whole file, or returns False if there is one."""
        temp = f"commits/_{uuid.uuid4().hex}"
        out = self.files.create(self._path(temp))
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.files.getUri().getScheme() == "file":
                local = lambda x: self._path(x).toUri().getPath()
                os.link(local(temp), local(name))
                return True
            return self.files.rename(self._path(temp), self._path(name))
        except FileExistsError:
            return False
        finally:
            self.files.delete(self._path(temp), False)

    def numbers(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self._names("commits") if x.endswith(".json") and x[0].isdigit())

    def head(self, number: int | None = None) -> Commit:
        """The commit of that number, or the last one."""
        numbers = self.numbers() if number is None else [number]
        return Commit(**json.loads(self._read_text(f"commits/{numbers[-1]:012d}.json"))) if numbers else Commit()

    def read(self, name: str, *, at: Commit | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table as of a commit, or some of its buckets; None if there is no such table."""
        table = (at or self.head()).tables.get(name)
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        chosen = table["parts"].values() if buckets is None else [table["parts"][str(b)] for b in buckets if str(b) in table["parts"]]
        paths = [f"{self.folder}/{p}" for p in sorted(chosen)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def writer(self, tries: int = 10) -> Writer:
        """Takes over the store."""
        for _ in range(tries):
            head = self.head()
            taken = Commit(head.number + 1, head.fence + 1, head.tables, head.state)
            if self._create(f"commits/{taken.number:012d}.json", json.dumps(vars(taken))):
                return Writer(self, taken.fence)
        raise Conflict(f"no commit of {self.folder} in {tries} tries")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all but the last ``keep`` commits, and the folders that none of those names; how many folders. Not while a writer
        or a reader of an older commit is at work."""
        numbers = self.numbers()
        kept = [self.head(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self.files.delete(self._path(f"commits/{n:012d}.json"), False)
        named = {p for c in kept for t in c.tables.values() for p in t["parts"].values()}
        versions, gone = {p.rsplit("/", 1)[0] for p in named}, 0
        for table in self._names("tables"):
            for version in self._names(f"tables/{table}"):
                place = f"tables/{table}/{version}"
                if place not in versions:
                    gone += self.files.delete(self._path(place), True)
                    continue
                for part in self._names(place):
                    if part.startswith(BUCKET) and f"{place}/{part}" not in named:
                        gone += self.files.delete(self._path(f"{place}/{part}"), True)
        return gone


def bucket_of(key: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


@dataclass
class Writer:
    """The only writer of a store as long as nobody takes over."""

    store: Store
    fence: int

    def start(self) -> Change:
        base = self.store.head()
        if base.fence != self.fence:
            raise Fenced(f"{self.store.folder} was taken over")
        return Change(self, base, {k: dict(v) for k, v in base.tables.items()}, dict(base.state))


@dataclass
class Change:
    """What the next commit is to hold; nothing of it is seen before ``commit``."""

    writer: Writer
    base: Commit
    tables: dict[str, dict]
    state: dict[str, object]

    def upsert(
        self, name: str, rows: DataFrame, key: tuple[str, ...], merge: Callable[[DataFrame | None, DataFrame], DataFrame], *, buckets: int = 64,
    ) -> list[int]:
        """Replaces the buckets that ``rows`` touch by ``merge(old rows of these buckets, rows)``; which they are. ``rows`` are read
        several times and should be a written table. The merge keeps a key in its bucket."""
        store, old = self.writer.store, self.tables.get(name)
        buckets = old["buckets"] if old else buckets
        touched = sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        known = self.read(name, touched)
        merged = merge(known, rows)
        place = f"tables/{name}/v-{uuid.uuid4().hex}"
        # A large bucket is written by several tasks, each of an advisory partition size, so none grows with the table.
        dealt = merged.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{store.folder}/{place}")
        parts = dict(old["parts"]) if old else {}
        parts = {b: p for b, p in parts.items() if int(b) not in touched}
        parts |= {x.split("=")[1]: f"{place}/{x}" for x in store._names(place) if x.startswith(f"{BUCKET}=")}
        self.tables[name] = {"schema": json.loads(merged.schema.json()), "buckets": buckets, "key": list(key), "parts": parts}
        return touched

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table as of this change."""
        return self.writer.store.read(name, at=Commit(tables=self.tables), buckets=buckets)

    def commit(self) -> Commit:
        """Makes the change the next commit: Conflict if there is one since the change began, Fenced if by a new writer."""
        store = self.writer.store
        made = Commit(self.base.number + 1, self.writer.fence, self.tables, self.state)
        if not store._create(f"commits/{made.number:012d}.json", json.dumps(vars(made))):
            raise Fenced(f"{store.folder} was taken over") if store.head().fence != self.writer.fence else Conflict(f"commit {made.number} exists")
        return made
