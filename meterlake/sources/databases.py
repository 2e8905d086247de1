"""Usage events and savings from agents' databases (shapes of tables: see FIXTURES.md)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import command_hash, head
from ..functions.identity import project_from_cwd
from ..functions.times import epoch, rfc3339, rfc3339_millis
from . import json_values as J
from .sqlite import counter, read_table, real, table_columns, table_stats, text, whole

GRACE_MS = 600_000
#: Fixed value: epochs from here on are milliseconds.
MS_EPOCH = 1_000_000_000_000


def discover(override: str | None, defaults: list[str]) -> list[str]:
    """An override is all there is, even if it is missing; else the defaults that exist."""
    return [override] if override else [p for p in defaults if os.path.exists(p)]


@dataclass(frozen=True)
class Cursor:
    """What was read last time; ``floor`` is the time from which rows are read again."""

    path: str = ""
    floor: int = 0
    rows: int = 0
    first_id: str | None = None


def next_floor(cursor: Cursor, path: str) -> int:
    """The cursor's floor, or 0 if this is another or a replaced database: other path, older newest row, fewer rows, other
    first id."""
    rows, newest, first_id = table_stats(path, "message", "time_updated")
    replaced = path != cursor.path or (newest or 0) < cursor.floor or rows < cursor.rows or (cursor.first_id is not None and first_id != cursor.first_id)
    return 0 if replaced else cursor.floor


def message_rows(spark: SparkSession, path: str, floor: int = 0) -> DataFrame:
    """Messages updated at or after the floor, with the session's version and the project's folder if there are such tables."""
    m = read_table(spark, path, "message", where=f"time_updated >= {int(floor)}")
    rows = m.select(text(m, "id").alias("id"), text(m, "session_id").alias("session_id"), whole(m, "time_created").alias("time_created"),
                    whole(m, "time_updated").alias("time_updated"), text(m, "data").alias("data"))
    none = F.lit(None).cast("string")
    if not (table_columns(path, "session") and table_columns(path, "project")):
        return rows.withColumns({"version": none, "worktree": none})
    s, p = read_table(spark, path, "session"), read_table(spark, path, "project")
    s = s.select(text(s, "id").alias("_s"), text(s, "project_id").alias("_sp"), text(s, "version").alias("version"))
    p = p.select(text(p, "id").alias("_p"), text(p, "worktree").alias("worktree"))
    return rows.join(s, F.col("session_id") == F.col("_s"), "left").join(p, F.col("_sp") == F.col("_p"), "left").drop("_s", "_sp", "_p")


def opencode_events(rows: DataFrame, now_ms: int) -> DataFrame:
    """One row a message: ``outcome`` event, skip (counted), ignore, or gated (unfinished and recent: read again later)."""
    v = rows.withColumn("v", J.parse(F.col("data")))
    parts = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache.read", "cache_creation_tokens": "cache.write", "reasoning_tokens": "reasoning"}
    v = v.withColumns({c: J.whole("v", f"$.tokens.{p}") for c, p in parts.items()})
    used = sum((F.col(c) for c in parts), F.lit(0)) > 0
    running = (J.kind("v", "$.time.completed") == "BIGINT").isNull() | (J.kind("v", "$.time.completed") != "BIGINT")
    outcome = (
        F.when(F.col("v").isNull(), "skip").when(J.text("v", "$.role") != "assistant", "ignore").when(F.coalesce(J.kind("v", "$.tokens") != "OBJECT", F.lit(True)), "skip")
        .when(~used, "ignore").when(running & (F.col("time_updated") >= now_ms - GRACE_MS), "gated").otherwise("event")
    )
    cost, model = J.number("v", "$.cost"), J.text("v", "$.modelID")
    cwd, root = J.text("v", "$.path.cwd"), J.text("v", "$.path.root")
    project = F.when(cwd != "", project_from_cwd(cwd)).when(root != "", project_from_cwd(root)).otherwise(F.coalesce("worktree", F.lit("")))
    return v.select(
        outcome.alias("outcome"), "time_updated", F.lit("opencode").alias("source"), F.col("id").alias("message_id"), F.lit("").alias("request_id"), "session_id",
        rfc3339_millis(F.col("time_created")).alias("ts"), F.when(model != "", model).otherwise("unknown").alias("model"), *parts, F.lit(0).cast("bigint").alias("cache_1h_tokens"),
        F.lit(0).cast("bigint").alias("cache_5m_tokens"), project.alias("project"), F.coalesce("version", F.lit("")).alias("agent_version"),
        F.when(cost > 0, cost).alias("cost_usd"), F.lit("estimated").alias("cost_basis"),
    )


def new_floor(events: DataFrame, floor: int) -> DataFrame:
    """One row: the next floor, never past a gated row."""
    gated = F.min(F.when(F.col("outcome") == "gated", F.col("time_updated")))
    return events.agg(F.least(gated, F.greatest(F.max("time_updated"), F.lit(floor))).alias("floor"))


def _hermes_ts(df: DataFrame, name: str) -> Column:
    """Epoch seconds or milliseconds, or ISO text without an offset; else null."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    number = real(df, name).cast("bigint")
    words = F.trim(text(df, name))
    zoned = F.substring(words, 20, 100).rlike("[+-]")
    scaled = F.when(number >= MS_EPOCH, rfc3339_millis(number)).otherwise(rfc3339(number))
    return F.when(number.isNotNull(), scaled).when(~zoned, rfc3339(epoch(words)))


def hermes_cost(df: DataFrame) -> tuple[Column, Column]:
    """(cost, basis), the first rule that holds: a real cost is logged; of estimates, metered routes are logged, subscriptions
    have no cost, others keep the figure; anything else has none."""
    actual, figure, mode = real(df, "actual_cost_usd"), real(df, "estimated_cost_usd"), text(df, "billing_mode")
    estimate = F.coalesce(text(df, "cost_status") == "estimated", F.lit(False))
    metered = F.coalesce(mode.isin("official_models_api", "official_docs_snapshot"), F.lit(False))
    included = F.coalesce(mode == "subscription_included", F.lit(False))
    cost = F.when(actual > 0, actual).when(estimate & ~included & (figure > 0), figure)
    return cost, F.when((actual > 0) | (estimate & metered & (figure > 0)), "logged").otherwise("estimated")


def hermes_events(sessions: DataFrame) -> DataFrame:
    """One cumulative event a session row: ``outcome`` event, skip (counted) or ignore (no tokens)."""
    if "id" not in sessions.columns:
        raise ValueError("the sessions table has no id column")
    parts = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_tokens", "cache_creation_tokens": "cache_write_tokens", "reasoning_tokens": "reasoning_tokens"}
    counts = {c: counter(sessions, p) for c, p in parts.items()}
    ts, sid = F.coalesce(_hermes_ts(sessions, "started_at"), _hermes_ts(sessions, "ended_at")), text(sessions, "id")
    cost, basis = hermes_cost(sessions)
    model, cwd = text(sessions, "model"), text(sessions, "cwd")
    none = sum(counts.values(), F.lit(0)) == 0
    outcome = F.when(none, "ignore").when(ts.isNull() | F.coalesce(sid == "", F.lit(True)), "skip").otherwise("event")
    return sessions.select(
        outcome.alias("outcome"), F.lit("hermes").alias("source"), sid.alias("message_id"), F.lit("").alias("request_id"), sid.alias("session_id"), ts.alias("ts"),
        F.when(model != "", model).otherwise("unknown").alias("model"), *(x.alias(c) for c, x in counts.items()), F.lit(0).cast("bigint").alias("cache_1h_tokens"),
        F.lit(0).cast("bigint").alias("cache_5m_tokens"), F.when(cwd != "", project_from_cwd(cwd)).otherwise(F.coalesce(text(sessions, "git_repo_root"), F.lit(""))).alias("project"),
        F.lit("").alias("agent_version"), cost.alias("cost_usd"), basis.alias("cost_basis"),
    )


def savings_rows(spark: SparkSession, path: str, cursor: int = 0) -> DataFrame:
    """Saved-token rows after a cursor; commands are hashed and their text is dropped."""
    t = read_table(spark, path, "commands", where=f"id > {int(cursor)}")
    command, none = text(t, "original_cmd"), F.lit(None).cast("string")
    return t.select(
        whole(t, "id").alias("rtk_row_id"), text(t, "timestamp").alias("ts"), command_hash(command).alias("cmd_hash"), command_hash(head(command)).alias("head_hash"),
        text(t, "project_path").alias("project_path"), whole(t, "saved_tokens").alias("saved_tokens"), none.alias("source"), none.alias("session_id"),
        F.lit(None).cast("bigint").alias("tool_event_id"), F.lit("none").alias("match_kind"),
    )


def savings_cursor(path: str, known_path: str, cursor: int) -> int:
    """The cursor, or 0 if this is another database or its rows are fewer."""
    _, newest, _ = table_stats(path, "commands", "id")
    return 0 if path != known_path or (newest or 0) < cursor else cursor
