"""Messages that are still being written: a row is let go once it is finished or has been quiet for a while.

An unfinished row may hold more tokens than the finished one will, and the ledger keeps the higher. So recent unfinished rows
wait in a table of their own, by message; each batch looks again at what waits and at its own rows, and what it lets go leaves
the table. Where to read on is never behind a row that waits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.databases import opencode_events


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each message: the latest update, of equal ones the greatest data."""
    kept = F.max(F.struct("time_updated", "data", *[c for c in rows.columns if c not in ("time_updated", "data", "id")])).alias("r")
    return rows.groupBy("id").agg(kept).select("id", "r.*").select(rows.columns)


def release(waiting: DataFrame | None, rows: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(judged rows, rows that wait): ``judged`` are ``databases.opencode_events`` of what is let go, with its outcome."""
    every = latest(rows if waiting is None else waiting.unionByName(rows))
    judged = opencode_events(every, now_ms)
    gated = judged.filter("outcome = 'gated'").select(F.col("message_id").alias("id"))
    return judged.filter("outcome <> 'gated'"), every.join(gated, "id", "left_semi")


def floor_of(waiting: DataFrame, rows: DataFrame, floor: int) -> int:
    """Where the next read begins: at the least row that waits, else at the newest row seen."""
    least = waiting.agg(F.min("time_updated")).first()[0]
    newest = rows.agg(F.max("time_updated")).first()[0]
    top = max(floor, newest) if newest is not None else floor
    return top if least is None else min(least, top)
