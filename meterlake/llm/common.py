"""Small helpers the corpus operators share: shared folders, Arrow text blocks, folds, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, ``spark.checkpoint.dir`` of the session; only a local session may do without."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = f"file://{tempfile.gettempdir()}/checkpoints-{os.getuid()}"
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and each row is computed once. Shuffle files
    of the job go as soon as it has ended."""
    return cut_to(df)[0]


def cut_to(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """As ``cut``, with the folder, which its owner may ``remove`` once what reads it has been written itself."""
    spark = df.sparkSession
    place, before = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(place)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(place), place


_SCANS = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "DataSourceV2ScanRelation", "DataSourceV2Relation"}


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it is read from files without a shuffle or Python code on the way, else a written copy. Only so do its rows have the
    same places, and ``monotonically_increasing_id`` the same numbers, each time it is computed: Spark may prune columns
    before a shuffle, and rows then go elsewhere."""
    left = [df._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        if node.nodeName() not in _SCANS or not node.deterministic():
            return cut(df)
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return df


def numbered(df: DataFrame, row: str) -> DataFrame:
    """Adds a number that names the row, the same each time what is returned is computed."""
    return stable(df).withColumn(row, F.monotonically_increasing_id())


def remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def valid_text(text: Column) -> Column:
    """The text with every malformed part of its UTF-8 replaced by U+FFFD."""
    return F.make_valid_utf8(text.cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that only the values decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


_MODEL: dict = {}


def worker_model(key: object, build: Callable[[], object]) -> object:
    """``build()``, kept by the worker process for its later tasks. A worker keeps one model alone, so that those of a
    pipeline's stages don't add up in its memory."""
    if key not in _MODEL:
        _MODEL.clear()
        release()
        _MODEL[key] = build()
    return _MODEL[key]


def release() -> None:
    """Gives freed memory back to the system: an idle worker keeps its process, beside the stages that don't need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of at most ``max_bytes`` or one text; null is an empty text."""
    rows, total, first = [], 0, 0
    for i, x in enumerate(texts.cast(pa.large_binary())):
        b = x.as_py() or b""
        if rows and total + len(b) > max_bytes:
            yield first, rows
            rows, total, first = [], 0, i
        rows.append(b)
        total += len(b)
    if rows:
        yield first, rows


def padded(rows: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, each behind ``pad`` zero bytes; where each text starts and ends."""
    gap = bytes(pad)
    buf = np.frombuffer(b"".join(x for r in rows for x in (gap, r)), np.uint8)
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(lens + pad)
    return buf, ends - lens, ends
