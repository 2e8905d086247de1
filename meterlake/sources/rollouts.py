"""Rollout lines, whose order in the file matters, to usage events.

Session, model and folder are running state: the last value seen above a line in its file. A ``session_meta`` line opens a
segment; where a segment may replay the history of another session, the events of the replay are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import project_from_cwd
from . import json_values as J

SOURCE = "codex"
_MARKS = ("session_meta", "turn_context", "compacted", "token_count")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Admitted lines as records of one shape: (file, line_no, kind, ...); see ``usage_events`` for the columns."""
    some = None
    for m in _MARKS:
        mark = F.col("text").contains(f'"{m}"')
        some = mark if some is None else some | mark
    rows = lines.filter(some).withColumn("v", J.parse(F.col("text")))
    kind, payload = J.text("v", "$.type"), J.text("v", "$.payload.type")
    is_count = (kind == "event_msg") & (payload == "token_count")
    rows = rows.withColumn(
        "kind",
        F.when(F.col("v").isNull(), F.when(F.col("text").contains('"token_count"'), "broken"))
        .when((kind == "session_meta") & J.kind("v", "$.payload").isNotNull(), "session_meta")
        .when((kind == "turn_context") & J.kind("v", "$.payload").isNotNull(), "turn_context").when(is_count, "token_count"),
    ).filter("kind IS NOT NULL")
    last, info = "$.payload.info.last_token_usage", J.kind("v", "$.payload.info")
    numbers = {n: J.tokens("v", f"{last}.{p}") for n, p in (("input", "input_tokens"), ("cached", "cached_input_tokens"), ("output", "output_tokens"), ("reasoning", "reasoning_output_tokens"))}
    total = J.tokens("v", "$.payload.info.total_token_usage.total_tokens")
    ts = J.text("v", "$.timestamp")
    whole = F.lit(True)
    for x in (*numbers.values(), total):
        whole = whole & x.isNotNull()
    zero = sum(numbers.values(), F.lit(0)) == 0
    long_enough = (F.octet_length(ts) >= 19) & (F.octet_length(F.substring(ts, 1, 19)) == 19)  # 19 bytes end on a character
    outcome = (
        F.when(F.col("kind") == "broken", "skip").when(F.col("kind") != "token_count", None)
        .when(info.isNull() | (info == "VOID"), "ignore").when(J.kind("v", last).isNull() | J.kind("v", "$.payload.info.total_token_usage.total_tokens").isNull(), "skip")
        .when(~whole, "skip").when(zero, "ignore").when(~long_enough, "skip").otherwise("ok")
    )
    p = "$.payload"
    meta = F.col("kind") == "session_meta"
    own = F.when(J.text("v", f"{p}.id") != "", J.text("v", f"{p}.id")).otherwise(J.text("v", f"{p}.session_id"))
    fork, subagent = J.kind("v", f"{p}.forked_from_id"), J.kind("v", f"{p}.source.subagent")
    none_if_empty = lambda x: F.when(x != "", x)
    return rows.select(
        F.col("path").alias("file"), "line_no", "kind", F.when(meta, none_if_empty(own)).alias("meta_session"),
        F.when(F.col("kind").isin("session_meta", "turn_context"), none_if_empty(J.text("v", f"{p}.cwd"))).alias("cwd"),
        F.when(meta, J.text("v", f"{p}.cli_version")).alias("version"),
        (meta & F.coalesce((fork.isNotNull() & (fork != "VOID")) | subagent.isNotNull(), F.lit(False))).alias("replay_suspect"),
        F.when(F.col("kind") == "turn_context", none_if_empty(J.text("v", f"{p}.model"))).alias("model"), outcome.alias("outcome"), ts.alias("ts"),
        *(x.alias(n) for n, x in numbers.items()), total.alias("cumulative"),
    )


def with_state(records: DataFrame) -> DataFrame:
    """Adds the state at each line: segment, session, model, folder, version, and the segment's flag."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = records.withColumns(
        {
            "segment": F.sum(F.when(F.col("kind") == "session_meta", 1).otherwise(0)).over(w), "session_id": last("meta_session"),
            "model": F.coalesce(last("model"), F.lit("unknown")), "cwd": F.coalesce(last("cwd"), F.lit("")), "agent_version": F.coalesce(last("version"), F.lit("")),
        }
    )
    no_session = (F.col("outcome") == "ok") & F.col("session_id").isNull()
    flag = F.max("replay_suspect").over(Window.partitionBy("file", "segment"))
    return rows.withColumns({"outcome": F.when(no_session, "skip").otherwise(F.col("outcome")), "flagged": flag})


def keep_after_replay(candidates: DataFrame) -> DataFrame:
    """Candidates of flagged segments less the replay: all events of the second in which two in a row fell first. Without
    such a pair the trailing events of one second are held back, as they may be its start."""
    seg = Window.partitionBy("file", "segment")
    ordered = seg.orderBy("line_no")
    rows = candidates.withColumn("sec", F.substring("ts", 1, 19)).withColumn("prev", F.lag("sec").over(ordered))
    again = F.col("prev") == F.col("sec")
    rows = rows.withColumns(
        {"replay": F.min_by("sec", F.when(again, F.col("line_no"))).over(seg), "pair": F.coalesce(F.max(again).over(seg), F.lit(False)), "last": F.max_by("sec", "line_no").over(seg)}
    )
    rows = rows.withColumn("replay", F.when(F.col("pair"), F.col("replay")))
    rows = rows.withColumn("last_diff", F.max(F.when(F.col("sec") != F.col("last"), F.col("line_no"))).over(seg))
    keep = ~F.col("flagged") | (F.col("pair") & (F.col("sec") != F.col("replay"))) | (~F.col("pair") & (F.col("line_no") <= F.coalesce("last_diff", F.lit(-1))))
    return rows.filter(keep).drop("sec", "prev", "replay", "pair", "last", "last_diff")


def usage_events(records: DataFrame) -> DataFrame:
    """Usage events of records with (file, line_no, kind, meta_session, cwd, version, replay_suspect, model, outcome, ts, input,
    cached, output, reasoning, cumulative). Input excludes cached tokens; the key is session and cumulative total."""
    return event_columns(keep_after_replay(with_state(records).filter("outcome = 'ok'")))


def event_columns(kept: DataFrame) -> DataFrame:
    """Usage events of counted records with their session, model, folder and version."""
    zero = F.lit(0).cast("bigint")
    return kept.select(
        "file", "line_no", F.lit(SOURCE).alias("source"), F.col("session_id").alias("message_id"), F.col("cumulative").cast("string").alias("request_id"), "session_id", "ts", "model",
        F.greatest(F.col("input") - F.col("cached"), zero).alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cached").alias("cache_read_tokens"),
        zero.alias("cache_creation_tokens"), zero.alias("cache_1h_tokens"), zero.alias("cache_5m_tokens"), F.col("reasoning").alias("reasoning_tokens"),
        project_from_cwd(F.col("cwd")).alias("project"), "agent_version", F.lit(None).cast("double").alias("cost_usd"), F.lit("estimated").alias("cost_basis"),
    )


def skipped(records: DataFrame) -> DataFrame:
    return with_state(records).agg(F.count_if(F.col("outcome") == "skip").alias("lines_skipped"))

