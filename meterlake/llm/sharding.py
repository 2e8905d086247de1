"""Sampled-splitter sharding: records are range-partitioned by a key into shards of near-equal bytes.

Keys are drawn with chance in proportion to the record's size, their quantiles are the range boundaries,
and ranges that turn out overfull (one hot key, or a poor sample) are subdivided by a salt. Exact sizes of
the ranges, a small table, then give each range its shard and each record its slot.

The key is by default the hash of the text, so equal texts lie together until their range is overfull.
Only DataFrame functions are used. What reaches the driver is the list of boundaries, bounded by
``max_ranges``; texts are read once and never shuffled.

Defined cases: null text has no bytes (size 1, crc32 0); null ids, ties and repeated rows keep a slot
each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit_hash


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are <= key, by two short scans: of every k-th boundary, then of those between."""
    k = max(1, math.isqrt(len(bounds)))
    coarse, fine = bounds[k - 1 :: k], [bounds[i : i + k] for i in range(0, len(bounds), k)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    if not bounds:
        return F.lit(0).cast("bigint")
    first = F.size(F.filter(longs(coarse), lambda x: x <= key)) if coarse else F.lit(0)
    rest = F.coalesce(F.get(F.array(*[longs(xs) for xs in fine]), first), longs([]))
    return (first * F.lit(k) + F.size(F.filter(rest, lambda x: x <= key))).cast("bigint")


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None,
    ranges_per_shard: int = 64, range_bytes: int = 64 << 20, max_ranges: int = 1 << 16, samples_per_range: int = 40,
) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot, range): sizes of shards are equal to within about a range."""
    text = F.col(text_col).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("_size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("_crc"),
            F.coalesce(key.cast("bigint") if key is not None else F.xxhash64(text), F.lit(0)).alias("_key"),
        )
    ).withColumn("_row", F.monotonically_increasing_id())
    total, count = rows.agg(F.sum("_size"), F.count("*")).first()
    total, count = total or 0, count or 0
    n = min(max_ranges, max(n_shards * ranges_per_shard, math.ceil(total / range_bytes)))

    chance = F.col("_size") * F.lit(n * samples_per_range / max(total, 1))
    sample = rows.filter(unit_hash(F.col("_id"), F.col("_row"), F.lit(7)) < chance)
    bounds = sample.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 4 * n)).first()[0] or []
    ranged = rows.withColumn("_range", _range_of(F.col("_key"), sorted(set(bounds))))

    fair = max(1.0, total / n)
    whole = ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes"))
    parts = whole.select("_range", F.greatest(F.lit(1), F.round(F.col("_bytes") / F.lit(fair))).cast("bigint").alias("_parts"))
    split = ranged.join(F.broadcast(parts), "_range").withColumn(  # at most max_ranges rows
        "_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_id", "_row"), F.col("_parts"))).otherwise(F.lit(0))
    )
    split = cut(split.drop("_parts"))

    sizes = split.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    in_order = Window.orderBy("_range", "_part")
    before = F.sum("_bytes").over(in_order) - F.col("_bytes") / F.lit(2)
    shards = sizes.withColumn(
        "_shard", F.least(F.lit(n_shards - 1), F.floor(before * F.lit(n_shards) / F.lit(float(max(total, 1))))).cast("int")
    )
    in_shard = Window.partitionBy("_shard").orderBy("_range", "_part")
    placed = shards.select(
        "_range", "_part", "_shard", (F.sum("_rows").over(in_shard) - F.col("_rows")).alias("_first")
    )
    in_range = Window.partitionBy("_range", "_part").orderBy("_key", "_row")
    return split.join(F.broadcast(placed), ["_range", "_part"]).select(  # at most twice max_ranges rows
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_first") + F.row_number().over(in_range) - 1).cast("bigint").alias("slot"),
        F.col("_range").alias("key_range"),
    )
