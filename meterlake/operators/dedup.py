"""Keeping one version of a row: highest total, first seen, last seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import total_tokens

USAGE_KEY = ("source", "message_id", "request_id")
FIRST_ROW = ("machine_id", "machine_name")


def _pick(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(w)).filter("_pick = 1").drop("_pick")


def keep_first(df: DataFrame, keys: tuple[str, ...], seq: str) -> DataFrame:
    return _pick(df, keys, F.col(seq).asc())


def keep_last(df: DataFrame, keys: tuple[str, ...], seq: str) -> DataFrame:
    return _pick(df, keys, F.col(seq).desc())


def keep_highest(events: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One event a key: that with the highest total, of equals the earliest. It takes the place of the first one:
    ``id`` and the machine are the first row's, and ``dirty`` says that a later row won."""
    by_total = Window.partitionBy(*USAGE_KEY).orderBy(total_tokens().desc(), F.col(seq).asc())
    every = Window.partitionBy(*USAGE_KEY).orderBy(F.col(seq)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {c: F.first(c).over(every) for c in (*FIRST_ROW, seq) if c in events.columns}
    marked = events.withColumns({f"_{c}": x for c, x in first.items()} | {"_pick": F.row_number().over(by_total)})
    kept = marked.filter("_pick = 1").withColumns({"id": F.col(f"_{seq}"), "dirty": F.col(seq) != F.col(f"_{seq}")})
    kept = kept.withColumns({c: F.col(f"_{c}") for c in FIRST_ROW if c in events.columns})
    return kept.drop("_pick", seq, *(f"_{c}" for c in first))


def upsert_outcomes(events: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """What a loop over the events by ``seq`` would report: inserted, replaced_higher, kept_existing."""
    before = Window.partitionBy(*USAGE_KEY).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(total_tokens()).over(before)
    outcome = F.when(best.isNull(), "inserted").when(total_tokens() > best, "replaced_higher").otherwise("kept_existing")
    return events.withColumn("outcome", outcome)


def keep_highest_remote(events: DataFrame) -> DataFrame:
    """One pulled record an event id: all columns of the one with the highest total, the earliest of equals."""
    return _pick(events, ("event_id",), total_tokens().desc(), F.col("server_seq").asc())
