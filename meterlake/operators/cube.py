"""Sums of usage kept up to date by signed deltas: what a replaced event had is taken out, what it has now is put in.

A cell is what all events of a day, source, model, project, session, machine and cost basis add up to. Token counts, events, and
costs (as decimals, and in whole micro-dollars an event) can be added and taken away exactly, in any order; a cell without events
goes. Everything the reports by day, model, project and session add up, and the dashboard's sums, comes from the cells.

``as_events`` has a cell look like one event of its day, so that the dashboard's sums (``operators.api`` by model, agent, project,
day, and the heat map) take cells for events. What counts events or wants a time of day doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import micro_usd
from ..functions.times import day
from ..plans.schema import TOKENS, total_tokens

CELL = ("day", "source", "model", "project", "project_label", "session_id", "machine_id", "cost_basis")
_COST = "decimal(38,12)"
SUMS = (*TOKENS, "events", "unpriced", "cost", "est_cost_microusd")


def cells(events: DataFrame, sign: int = 1) -> DataFrame:
    """What the events of the ledger's ``usage`` put into the cells, or take out of them."""
    cost = F.coalesce(F.col("cost_usd").cast("decimal(28,12)"), F.lit(0).cast("decimal(28,12)"))
    measures = {c: F.col(c) for c in TOKENS} | {
        "events": F.lit(1), "unpriced": F.col("cost_usd").isNull().cast("int"), "cost": cost, "est_cost_microusd": F.coalesce(micro_usd(F.col("cost_usd")), F.lit(0)),
    }
    keyed = events.withColumn("day", day(F.col("ts"))).select(*CELL, *((x * sign).alias(c) for c, x in measures.items()))
    return _added(keyed)


def _added(rows: DataFrame) -> DataFrame:
    kind = lambda c: _COST if c == "cost" else "bigint"
    return rows.groupBy(*CELL).agg(*(F.sum(c).cast(kind(c)).alias(c) for c in SUMS))


def add(known: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The cells with a delta of the same columns; cells without events go."""
    every = delta if known is None else known.select(*CELL, *SUMS).unionByName(delta)
    return _added(every).filter("events <> 0")


def delta(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """How the cells change if the rows ``before`` become the rows ``after``; cells that don't change are left out."""
    new = cells(after)
    both = new if before is None else _added(new.unionByName(cells(before, -1)))
    changed = F.lit(False)
    for c in SUMS:
        changed = changed | (F.col(c) != 0)
    return both.filter(changed)


def _report(found: DataFrame, key: Column) -> DataFrame:
    sums = found.groupBy(key.alias("key")).agg(
        F.sum("events").alias("events"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")),
        F.sum(total_tokens()).alias("total_tokens"), F.when(F.sum("events") > F.sum("unpriced"), F.sum("cost").cast("double")).alias("cost_usd"), F.sum("unpriced").alias("unpriced_events"),
    )
    return sums


def since(found: DataFrame, first_day: str | None) -> DataFrame:
    return found if first_day is None else found.filter(F.col("day") >= first_day)


def daily(found: DataFrame) -> DataFrame:
    return _report(found, F.col("day")).withColumn("saved_tokens", F.lit(None).cast("bigint")).orderBy("key")


def models(found: DataFrame) -> DataFrame:
    return _report(found, F.col("model")).withColumn("saved_tokens", F.lit(None).cast("bigint")).orderBy(F.desc("total_tokens"), "key")


def projects(found: DataFrame, savings: DataFrame) -> DataFrame:
    saved = savings.groupBy(F.col("project_path").alias("key")).agg(F.sum("saved_tokens").alias("saved_tokens"))
    return _report(found, F.col("project")).join(saved, "key", "left").orderBy(F.desc("total_tokens"), "key")


def sessions(found: DataFrame, savings: DataFrame) -> DataFrame:
    """Only attributed savings count; a session of several sources takes those of the first source by name."""
    saved = savings.groupBy("source", F.col("session_id").alias("key")).agg(F.sum("saved_tokens").alias("saved_tokens"))
    first = found.groupBy(F.col("session_id").alias("key")).agg(F.min("source").alias("source"))
    sums = _report(found, F.col("session_id")).join(first, "key")
    return sums.join(saved, ["source", "key"], "left").drop("source").orderBy(F.desc("total_tokens"), "key")


def as_events(found: DataFrame) -> DataFrame:
    """Cells in the columns that the dashboard's sums read; ``ts`` is the day."""
    return found.withColumn("ts", F.col("day"))
