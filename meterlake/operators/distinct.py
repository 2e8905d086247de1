"""Distinct counts that can be added: a day's sessions, projects and machines as exact bitmaps.

Values get numbers from a dictionary, which only grows. A day's row of a kind has the numbers seen, by project, machine and source,
as bitmaps of 32,768 bits; or-ing the rows of any days, projects, machines and sources and counting bits gives the number of
different values. Rows of two batches of the same day are or-ed too, so the table grows by batches without reading events again.
What was seen stays seen: an event that is replaced by a higher version of itself is of the same session and project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day

KINDS = {"session": "session_id", "project": "project_label", "machine": "machine_id"}
DIMS = ("day", "project_label", "machine_id", "source")
_PARTS = 4096


def dictionary(known: DataFrame | None, events: DataFrame) -> DataFrame:
    """(kind, value, number): the known values and those new in the events, numbered from 0 for each kind without gaps.

    New values are dealt to parts by hash and numbered within them, so no kind is one task's work."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()))).alias("x")
    values = events.select(kinds).select("x.*").filter("value IS NOT NULL").distinct()
    if known is not None:
        values = values.join(known.select("kind", "value"), ["kind", "value"], "left_anti")
    values = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(_PARTS)))
    sizes = values.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = sizes.select("kind", "part", (F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("kind", "part").orderBy("value")) - 1
    new = values.withColumn("at", at).join(before, ["kind", "part"])
    if known is None:
        return new.select("kind", "value", (F.col("before") + F.col("at")).alias("number"))
    first = known.groupBy("kind").agg((F.max("number") + 1).alias("first"))  # a row a kind
    numbered = new.join(F.broadcast(first), "kind", "left").select("kind", "value", (F.coalesce("first", F.lit(0)) + F.col("before") + F.col("at")).alias("number"))
    return known.select("kind", "value", "number").unionByName(numbered)


def bitmaps(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row a kind, day, project, machine, source and range of numbers: the bitmap of the values seen."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()))).alias("x")
    seen = events.select(day(F.col("ts")).alias("day"), *DIMS[1:], kinds).select(*DIMS, "x.kind", "x.value").distinct()
    placed = seen.join(numbers, ["kind", "value"]).select(*DIMS, "kind", F.bitmap_bucket_number("number").alias("range"), F.bitmap_bit_position("number").alias("bit"))
    return placed.groupBy(*DIMS, "kind", "range").agg(F.bitmap_construct_agg("bit").alias("bits"))


def either(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """The bitmaps of both."""
    every = new if known is None else known.unionByName(new)
    return every.groupBy(*DIMS, "kind", "range").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(chosen: DataFrame, *by: str) -> DataFrame:
    """(by, sessions, projects, machines): how many different values the chosen rows have, for each value of ``by``."""
    ranges = chosen.groupBy(*by, "kind", "range").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    one = ranges.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}s") for k in KINDS))
    return one
