"""The command-line reports over local usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import day, days_before
from ..plans.schema import total_tokens


def since(events: DataFrame, first_day: str | None) -> DataFrame:
    """Events from a day on, by comparing text."""
    return events if first_day is None else events.filter(F.col("ts") >= first_day)


def cost_sum() -> Column:
    """Dollars, added up as decimals: the same in whatever order. Null if no event has a cost."""
    return F.sum(F.col("cost_usd").cast("decimal(28,12)")).cast("double")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("events"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")),
        F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("total_tokens"),
        cost_sum().alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_events"),
    ]


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(day(F.col("ts")).alias("key")).agg(*_sums()).withColumn("saved_tokens", F.lit(None).cast("bigint")).orderBy("key")


def models(events: DataFrame) -> DataFrame:
    sums = events.groupBy(F.col("model").alias("key")).agg(*_sums()).withColumn("saved_tokens", F.lit(None).cast("bigint"))
    return sums.orderBy(F.desc("total_tokens"), "key")


def projects(events: DataFrame, savings: DataFrame) -> DataFrame:
    """By full path. All savings of a project count, attributed or not."""
    sums = events.groupBy(F.col("project").alias("key")).agg(*_sums())
    saved = savings.groupBy(F.col("project_path").alias("key")).agg(F.sum("saved_tokens").alias("saved_tokens"))
    return sums.join(saved, "key", "left").orderBy(F.desc("total_tokens"), "key")


def sessions(events: DataFrame, savings: DataFrame) -> DataFrame:
    """Only attributed savings count; a session of several sources takes those of the first source by name."""
    sums = events.groupBy(F.col("session_id").alias("key")).agg(*_sums(), F.min("source").alias("source"))
    saved = savings.groupBy("source", F.col("session_id").alias("key")).agg(F.sum("saved_tokens").alias("saved_tokens"))
    return sums.join(saved, ["source", "key"], "left").drop("source").orderBy(F.desc("total_tokens"), "key")


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("events"), F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("total_tokens"), cost_sum().alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_events"), F.count_distinct("session_id").alias("sessions"),
        F.min(day(F.col("ts"))).alias("first_day"),
    )


def top_by_cost(report: DataFrame) -> DataFrame:
    """The costliest row of a report; no cost counts as 0, ties go to more tokens."""
    return report.orderBy(F.coalesce("cost_usd", F.lit(0.0)).desc(), F.desc("total_tokens"), "key").limit(1)


def overview(events: DataFrame, savings: DataFrame, as_of: str) -> DataFrame:
    """One row: totals of the last 30 days and of today, the costliest model and project of the 30 days."""
    window = since(events, days_before(as_of, 30))
    parts = [
        totals(window).select(*(F.col(c).alias(f"window_{c}") for c in ("events", "total_tokens", "cost_usd", "sessions"))),
        totals(since(events, as_of[:10])).select(*(F.col(c).alias(f"today_{c}") for c in ("events", "total_tokens", "cost_usd", "sessions"))),
        top_by_cost(models(window)).agg(F.max("key").alias("top_model")),
        top_by_cost(projects(window, savings)).agg(F.max("key").alias("top_project")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("json"))
