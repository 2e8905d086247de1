"""Hard negatives: for each anchor its nearest rows of the same label, and rows of other labels that come close to each of them.

Vectors become whole numbers, floor(scale * x), and a score is the inner product of two, computed as a product of dense blocks in
float64. Sums of whole numbers are exact there below 2**53; the largest squared length of a vector bounds every partial sum,
and where it is too large the blocks are int64 instead (beyond 2**62 an error is raised).

Anchors are taken in blocks of bounded size, one after another. A block is broadcast and every task multiplies it with its own
rows, a few thousand at a time: nothing of the rows is shuffled or sent to the driver. The first pass keeps the best
``positives`` of the same label for each anchor in each task, and Spark merges them; the merged scores, a few for each anchor of
the block, are broadcast for the second pass, which keeps the best ``negatives`` of other labels that score between ``floor`` and all of
a positive's score. So the work is rows times anchors, as it must be, and a task's memory is two blocks and a product of them.

Scores come highest first, ties by the smaller id. Defined cases: rows with a null label, a null vector or any null or non-finite
component take no part, nor do rows without an id; repeated rows are rows of their own (another row may have the
anchor's id, and an anchor that stands there twice has its results twice); of vectors of different lengths the missing components count as
0; an empty table, no anchors or no positives give an empty result; columns other than the three are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

_FOUND = "slot bigint, score bigint, id bigint, row bigint"
_LOWEST = np.iinfo(np.int64).min
#: Rows multiplied at a time.
_CHUNK = 4096


def whole_vectors(rows: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(row, id, label, anchor, q) of the rows that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    q = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), q.cast("array<bigint>").alias("q"),
    )


def matrix(column: pa.Array, dims: int, exact: bool) -> np.ndarray:
    """Rows of whole numbers, zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind, lengths = (np.int64 if exact else np.float64), np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), kind)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Best:
    """The first ``k`` of each slot by falling score, then id, then row; mergeable, as any part's first ones are kept."""

    def __init__(self, slots: int, k: int):
        self.k, self.rows = k, np.zeros((0, 4), np.int64)  # slot, score, id, row
        self.least = np.full(slots, _LOWEST, np.int64)  # what a score must reach to count

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        new = np.stack([slot, score, ids, row], axis=1)
        every = np.concatenate([self.rows, new])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        first = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        rank = np.arange(len(every)) - np.repeat(first, np.diff(np.append(first, len(every))))
        self.rows = every[rank < self.k]
        full = every[rank == self.k - 1]
        self.least[full[:, 0]] = full[:, 1]

    def take(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Adds the allowed of a matrix of scores, whose lines are slots; only those that can be among the first are sorted."""
        allowed = allowed & (scores >= self.least[slots][:, None])
        many = allowed.sum(1) > self.k
        if many.any():
            open_ = np.where(allowed[many], scores[many], _LOWEST)
            kth = np.partition(open_, open_.shape[1] - self.k, axis=1)[:, open_.shape[1] - self.k]
            allowed[many] &= scores[many] >= kth[:, None]
        a, b = np.nonzero(allowed)
        if len(a):
            self.add(slots[a], scores[a, b].astype(np.int64), ids[b], row[b])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in self.rows.T.copy()], names=["slot", "score", "id", "row"])


@dataclass
class AnchorBlock:
    """Anchors of one block; labels are numbered, and ``codes`` has the number of each."""

    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    codes: dict[str, int]

    @staticmethod
    def of(found: pa.Table, dims: int, exact: bool) -> AnchorBlock:
        names = found.column("label").to_pylist()
        codes = {x: k for k, x in enumerate(sorted(set(names)))}
        return AnchorBlock(found.column("row").to_numpy(), np.array([codes[x] for x in names], np.int64), matrix(found.column("q"), dims, exact), codes)


def _chunks(batches: Iterator[pa.RecordBatch], block: AnchorBlock, dims: int, exact: bool) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(k, _CHUNK)
            label = np.array([block.codes.get(x, -1) for x in part.column("label").to_pylist()], np.int64)
            yield part.column("row").to_numpy(), part.column("id").to_numpy(), label, matrix(part.column("q"), dims, exact)


def _positives(shared, k: int, dims: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(len(block.row), k)
        for row, ids, label, q in _chunks(batches, block, dims, exact):
            for code in np.unique(label[label >= 0]):
                mine, theirs = np.flatnonzero(block.label == code), np.flatnonzero(label == code)
                scores = block.q[mine] @ q[theirs].T
                best.take(mine, scores, block.row[mine][:, None] != row[theirs], ids[theirs], row[theirs])
        yield best.batch()

    return run


def _negatives(shared, wanted, k: int, dims: int, exact: bool):
    """``wanted``: (anchor's place, least score, most score) of each slot, those of an anchor next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, slots = shared.value, wanted.value
        at, low, high = slots.T
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        best = Best(len(at), k)
        for row, ids, label, q in _chunks(batches, block, dims, exact):
            scores, other = block.q @ q.T, block.label[:, None] != label
            for n in range(int(nth.max()) + 1 if len(nth) else 0):
                own = np.flatnonzero(nth == n)
                line = scores[at[own]]
                best.take(own, line, other[at[own]] & (line <= high[own][:, None]) & (line >= low[own][:, None]), ids, row)
        yield best.batch()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (4, 5), block_bytes: int = 16 << 20, block_rows: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``anchor`` holds, its first
    ``positives`` other rows of the same label, and for each of them the first ``negatives`` rows of other labels with
    positive_score * floor <= negative_score <= positive_score."""
    spark = rows.sparkSession
    every = cut(whole_vectors(rows, anchor, id_col, vec_col, label_col, scale))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dims, longest = every.agg(F.count_if("anchor"), F.max(F.size("q")), F.max(square)).first()
    dims, longest = dims or 0, longest or 0.0
    if longest >= 2.0**62:
        raise OverflowError("a score may not fit 64 bits")
    exact = longest >= 2.0**52  # half of what float64 holds: the bound itself is rounded
    size = max(1, min(block_rows, block_bytes // max(1, 8 * dims)))
    blocks = -(-n // size)
    out = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    candidates = every.select("row", "id", "label", "q")
    for b in range(blocks):
        some = every.filter(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "label", "q").toArrow()  # about ``size`` rows
        if not some.num_rows:
            continue
        anchor_ids = some.column("id").to_numpy()
        shared = spark.sparkContext.broadcast(AnchorBlock.of(some, dims, exact))
        near = _merged(candidates.mapInArrow(_positives(shared, positives, dims, exact), _FOUND), positives).toArrow()  # a few an anchor
        near = near.sort_by([("slot", "ascending"), ("rank", "ascending")])
        at, score = near.column("slot").to_numpy(), near.column("score").to_pylist()
        low = np.array([-(-s * floor[0] // floor[1]) for s in score], np.int64)  # rounded up; above a negative score itself
        wanted = spark.sparkContext.broadcast(np.stack([at, low, np.array(score, np.int64)], axis=1))
        found = _merged(candidates.mapInArrow(_negatives(shared, wanted, negatives, dims, exact), _FOUND), negatives)
        pairs = pa.table({"slot": np.arange(len(at)), "anchor_id": anchor_ids[at], "positive_id": near.column("id"), "positive_score": near.column("score")})
        named = found.join(F.broadcast(spark.createDataFrame(pairs)), "slot")  # ``positives`` rows an anchor of the block
        named.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
        shared.unpersist()
        wanted.unpersist()
    return spark.read.schema(schema).parquet(out)
