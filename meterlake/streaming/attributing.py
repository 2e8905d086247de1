"""Attribution kept: savings rows and tool events come in any order, and each row has the match that all events so far give it.

Both tables lie in the store by hour, so that a batch reads and rewrites the hours it touches and their neighbours, whatever the
size of the ledger. A batch looks again at its own rows and at the rows near its events, and a match found earlier is withdrawn
if a better one has come. Rows older than the horizon keep what they have; those that were never looked at are looked at once,
however old.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch
from ..operators.attribution import attribute
from .store import Change, bucket_of

SLOT_S = 3600
_MATCH = ("source", "session_id", "tool_event_id", "match_kind")


@dataclass(frozen=True)
class Attributed:
    """Rows looked at, by what they have now, and how many have another match than before."""

    text: int = 0
    window: int = 0
    none: int = 0
    changed: int = 0


def with_slot(rows: DataFrame) -> DataFrame:
    """Adds the hour; rows without a time are of hour 0."""
    return rows.withColumn("slot", F.coalesce(F.floor(epoch(F.col("ts")) / SLOT_S), F.lit(0)).cast("bigint"))


def _newest(key: str):
    return lambda old, new: new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _of_slots(change: Change, name: str, slots: DataFrame) -> DataFrame | None:
    """The table's rows of some hours, from the buckets that have them."""
    table = change.tables.get(name)
    if table is None:
        return None
    buckets = [r[0] for r in slots.select(bucket_of(("slot",), table["buckets"])).distinct().collect()]  # at most one number a bucket
    return change.read(name, buckets).join(slots, "slot", "left_semi")


def keep(
    change: Change, savings: DataFrame, bash_events: DataFrame, as_of_epoch: int, write, *, window_s: int = 120, horizon_s: int = 48 * 3600, buckets: int = 64,
) -> Attributed:
    """Takes new savings rows (``match_kind`` none) and Bash events into the tables ``savings`` and ``bash`` of a change. ``write(df,
    name)`` writes a frame and reads it back."""
    if window_s > SLOT_S:
        raise ValueError("a window is an hour at most")
    events = write(with_slot(bash_events).dropDuplicates(["id"]), "bash")
    rows = write(with_slot(savings).dropDuplicates(["rtk_row_id"]).withColumn("looked", F.lit(False)), "savings")
    change.upsert("bash", events, ("slot",), _newest("id"), buckets=buckets)
    known = _of_slots(change, "savings", rows.select("slot").distinct())  # a row that comes again keeps its match
    fresh = write(rows if known is None else rows.join(known.select("rtk_row_id"), "rtk_row_id", "left_anti"), "fresh")
    change.upsert("savings", fresh, ("slot",), _newest("rtk_row_id"), buckets=buckets)

    around = lambda df: df.select(F.explode(F.array(*(F.col("slot") + k for k in (-1, 0, 1)))).alias("slot")).distinct()
    near = write(around(events.select("slot").union(fresh.select("slot"))), "near")
    there, found = _of_slots(change, "savings", near), _of_slots(change, "bash", around(near))
    if there is None:
        return Attributed()
    looked = write(there.filter(~F.col("looked") | (epoch(F.col("ts")) > as_of_epoch - horizon_s)), "looked")
    matched = looked if found is None else attribute(looked, found, window_s)
    was = looked.select("rtk_row_id", F.struct(*_MATCH).alias("was"), F.col("looked").alias("before"))
    both = write(matched.join(was, "rtk_row_id").withColumns({"looked": F.lit(True), "changed": ~F.struct(*_MATCH).eqNullSafe(F.col("was"))}), "matched")
    change.upsert("savings", both.filter("changed OR NOT before").select(there.columns), ("slot",), _newest("rtk_row_id"), buckets=buckets)
    return Attributed(*both.agg(*(F.count_if(F.col("match_kind") == k) for k in ("text", "window", "none")), F.count_if("changed")).first())
