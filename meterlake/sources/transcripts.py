"""Transcript lines (one JSON record each) to usage events, tool uses and tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commands import chain_hashes, chain_head_hashes
from ..functions.identity import project_from_cwd
from ..operators.tools import est_tokens
from . import json_values as J

SOURCE = "claude_code"
_MARKS = ('"usage"', '"tool_use"', '"tool_result"')
_VERSION = r"^\d+\.\d+\.\d+([-+].*)?$"


def admitted(lines: DataFrame) -> DataFrame:
    """Lines that may carry what is read here, parsed into ``v`` (null: not JSON)."""
    some = None
    for m in _MARKS:
        some = F.col("text").contains(m) if some is None else some | F.col("text").contains(m)
    return lines.filter(some).withColumn("v", J.parse(F.col("text")))


def usage_events(lines: DataFrame) -> DataFrame:
    """One row an admitted line: ``outcome`` is event, skip (counted) or ignore; the other columns hold for events."""
    rows = admitted(lines)
    usage, cost = "$.message.usage", J.number("v", "$.costUSD")
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    parts = {n: J.tokens("v", f"{usage}.{n}") for n in names}
    strings = {
        "model": "$.message.model", "message_id": "$.message.id", "session_id": "$.sessionId", "request_id": "$.requestId",
        "agent_version": "$.version", "ts": "$.timestamp", "_cwd": "$.cwd",
    }
    rows = rows.withColumns({c: J.text("v", p) for c, p in strings.items()} | {f"_{n}": x for n, x in parts.items()})
    is_usage = (J.kind("v", "$.message") == "OBJECT") & J.kind("v", usage).isNotNull()
    valid = J.kind("v", usage) == "OBJECT"
    for c in ("model", "message_id", "session_id", "request_id", "ts"):
        valid = valid & (F.col(c) != "")
    valid = valid & F.col("agent_version").rlike(_VERSION)
    for n in names:
        valid = valid & F.col(f"_{n}").isNotNull()
    outcome = F.when(F.col("v").isNull(), "skip").when(~F.coalesce(is_usage, F.lit(False)), "ignore").when(F.coalesce(valid, F.lit(False)), "event").otherwise("skip")
    logged = F.coalesce(cost >= 0, F.lit(False))
    split = {c: J.whole("v", f"{usage}.cache_creation.ephemeral_{t}_input_tokens") for c, t in (("cache_1h_tokens", "1h"), ("cache_5m_tokens", "5m"))}
    return rows.select(
        "path", "line_no", outcome.alias("outcome"), F.lit(SOURCE).alias("source"), "message_id", "request_id", "session_id", "ts", "model",
        F.col("_input_tokens").alias("input_tokens"), F.col("_output_tokens").alias("output_tokens"), F.col("_cache_read_input_tokens").alias("cache_read_tokens"),
        F.col("_cache_creation_input_tokens").alias("cache_creation_tokens"), *(x.alias(c) for c, x in split.items()), F.lit(0).cast("bigint").alias("reasoning_tokens"),
        project_from_cwd(F.col("_cwd")).alias("project"), "agent_version", F.when(logged, cost).alias("cost_usd"),
        F.when(logged, "logged").otherwise("estimated").alias("cost_basis"),
    )


def _blocks(lines: DataFrame, kind: str) -> DataFrame:
    rows = admitted(lines).withColumns({"session_id": J.text("v", "$.sessionId"), "ts": J.text("v", "$.timestamp"), "_cwd": J.text("v", "$.cwd")})
    rows = rows.filter((F.col("session_id") != "") & (F.col("ts") != ""))
    each = rows.select("path", "line_no", "session_id", "ts", "_cwd", F.posexplode(J.elements("v", "$.message.content")).alias("block_no", "b"))
    return each.filter(J.text("b", "$.type") == kind)


def tool_uses(lines: DataFrame) -> DataFrame:
    rows = _blocks(lines, "tool_use").withColumns({"tool_use_id": J.text("b", "$.id"), "tool_name": J.text("b", "$.name"), "_command": J.text("b", "$.input.command")})
    bash = (F.col("tool_name") == "Bash") & F.col("_command").rlike(r"(?U)\S")
    return rows.filter("tool_use_id <> '' AND tool_name <> ''").select(
        "path", "line_no", "block_no", F.lit(SOURCE).alias("source"), "session_id", "tool_use_id", "ts", project_from_cwd(F.col("_cwd")).alias("project"), "tool_name",
        est_tokens(F.coalesce(J.json_bytes("b", "$.input"), F.lit(2))).alias("est_args_tokens"),
        F.when(bash, chain_head_hashes(F.col("_command"))).alias("head_hashes"), F.when(bash, chain_hashes(F.col("_command"))).alias("chain_hashes"),
    )


def _content_bytes() -> Column:
    """Bytes of a result: of a string, of all texts if every block is text, else of the JSON."""
    items = J.elements("b", "$.content")
    part = lambda x, p: F.try_variant_get(x, p, "string")
    all_text = F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(part(x, "$.type") == "text", F.lit(False))), F.lit(False))
    texts = F.aggregate(items, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(part(x, "$.text")), F.lit(0)))
    k = J.kind("b", "$.content")
    return F.when(k.isNull(), 0).when(k == "STRING", F.octet_length(J.text("b", "$.content"))).when(all_text, texts).otherwise(J.json_bytes("b", "$.content"))


def tool_results(lines: DataFrame) -> DataFrame:
    rows = _blocks(lines, "tool_result").withColumn("tool_use_id", J.text("b", "$.tool_use_id"))
    error = (J.kind("b", "$.is_error") == "BOOLEAN") & F.try_variant_get("b", "$.is_error", "boolean")
    return rows.filter("tool_use_id <> ''").select(
        "path", "line_no", "block_no", F.lit(SOURCE).alias("source"), "session_id", "tool_use_id", "ts", est_tokens(_content_bytes()).alias("est_result_tokens"),
        F.coalesce(error, F.lit(False)).alias("is_error"),
    )


def scan_summary(events: DataFrame) -> DataFrame:
    """Events and skipped lines of a scan."""
    return events.agg(F.count_if(F.col("outcome") == "event").alias("events"), F.count_if(F.col("outcome") == "skip").alias("lines_skipped"))
