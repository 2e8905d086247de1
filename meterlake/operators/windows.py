"""Trailing windows kept up to date: tokens a second, by signed deltas as in ``cube``.

The plan's windows (5 hours, 7 days) ask for tokens up to a moment and for the first second that counts, so seconds are as fine
as they need. A batch adds its events, takes out what replaced ones had, and late rows fall into their second; at each trigger
the windows read the seconds of the last days in place of all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import day
from ..plans.schema import TOKENS, total_tokens

SECOND = ("day", "ts", "source", "cost_basis", "project_label", "machine_id")
_SUMS = ("tokens", "events")


def seconds(events: DataFrame, sign: int = 1) -> DataFrame:
    """What the events put into the seconds, or take out of them; ``ts`` is cut to whole seconds."""
    rows = events.select(
        day(F.col("ts")).alias("day"), F.concat(F.substring("ts", 1, 19), F.lit("Z")).alias("ts"), *SECOND[2:], (total_tokens() * sign).alias("tokens"), F.lit(sign).alias("events")
    )
    return _added(rows)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SECOND).agg(*(F.sum(c).cast("bigint").alias(c) for c in _SUMS))


def add(known: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The seconds with a delta; those without events go."""
    every = delta if known is None else known.select(*SECOND, *_SUMS).unionByName(delta)
    return _added(every).filter("events <> 0")


def delta(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """How the seconds change if the rows ``before`` become the rows ``after``."""
    new = seconds(after)
    both = new if before is None else _added(new.unionByName(seconds(before, -1)))
    return both.filter("tokens <> 0 OR events <> 0")


def as_events(kept: DataFrame) -> DataFrame:
    """Seconds in the columns that ``api.plan_windows`` reads: a second is one event."""
    zero = F.lit(0).cast("bigint")
    return kept.select(*SECOND[1:], F.col("tokens").alias(TOKENS[0]), *(zero.alias(c) for c in TOKENS[1:]))
