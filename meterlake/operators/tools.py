"""Tool calls: uses paired with results, open uses, token totals by tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day, days_before
from .dedup import keep_first, keep_last

CALL = ("source", "session_id", "tool_use_id")


def est_tokens(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4).cast("bigint")


def pair(uses: DataFrame, results: DataFrame) -> DataFrame:
    """One tool event a call: the last use and the first result of its key, if the use was seen no later than the result.
    Both sides carry ``seq``. The event's time is the result's."""
    use = keep_last(uses, CALL, "seq").withColumnRenamed("seq", "use_seq")
    result = keep_first(results, CALL, "seq").select(*CALL, F.col("seq").alias("result_seq"), F.col("ts").alias("result_ts"), "est_result_tokens", "is_error")
    joined = use.join(result, list(CALL)).filter("use_seq <= result_seq")
    return joined.withColumn("ts", F.col("result_ts")).drop("result_ts", "use_seq", "result_seq")


def pending(uses: DataFrame, events: DataFrame) -> DataFrame:
    """Uses without a tool event."""
    return keep_last(uses, CALL, "seq").join(events.select(*CALL), list(CALL), "left_anti")


def prune(open_uses: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return open_uses.filter(day(F.col("ts")) >= days_before(as_of, days))


def filtered(df: DataFrame, *, days: int | None = None, session: str | None = None, as_of: str | None = None) -> DataFrame:
    """The last ``days`` days, the first one included, and one session."""
    if days is not None:
        if days <= 0:
            raise ValueError("days must be positive")
        df = df.filter(day(F.col("ts")) >= days_before(as_of, days))
    return df if session is None else df.filter(F.col("session_id") == session)


def by_tool(events: DataFrame) -> DataFrame:
    """Calls and estimated tokens by tool, with the share of all in per cent."""
    sums = events.groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.sum("est_args_tokens").alias("est_args_tokens"), F.sum("est_result_tokens").alias("est_result_tokens")
    ).withColumn("est_total_tokens", F.col("est_args_tokens") + F.col("est_result_tokens"))
    grand = F.sum("est_total_tokens").over(Window.partitionBy())
    share = F.when(grand > 0, F.lit(100.0) * F.col("est_total_tokens") / grand).otherwise(0.0)
    return sums.withColumn("share_pct", share).orderBy(F.desc("est_total_tokens"), "tool_name")


def savings_totals(savings: DataFrame) -> DataFrame:
    """Commands and saved tokens; no row if there are no commands."""
    return savings.agg(F.count("*").alias("commands"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")).filter("commands > 0")
