"""Schemas of the ledger's tables and the few expressions every report shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")

USAGE = (
    "id bigint, source string, message_id string, request_id string, session_id string, ts string, model string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, "
    "cache_1h_tokens bigint, cache_5m_tokens bigint, reasoning_tokens bigint, project string, agent_version string, "
    "cost_usd double, cost_basis string, project_label string, machine_id string, machine_name string, dirty boolean"
)
REMOTE = (
    "server_seq bigint, event_id string, ts string, agent string, model string, project_label string, session_id string, "
    "machine_id string, machine_name string, cost_basis string, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_creation_tokens bigint, reasoning_tokens bigint, est_cost_microusd bigint"
)
TOOL_EVENTS = (
    "id bigint, source string, session_id string, tool_use_id string, ts string, project string, tool_name string, "
    "est_args_tokens bigint, est_result_tokens bigint, is_error boolean, head_hashes array<string>, chain_hashes array<string>"
)
SAVINGS = (
    "rtk_row_id bigint, ts string, cmd_hash string, head_hash string, project_path string, saved_tokens bigint, "
    "source string, session_id string, tool_event_id bigint, match_kind string"
)
MERGED = (
    "source", "session_id", "ts", "model", *TOKENS, "cost_basis", "est_cost_microusd", "unpriced", "project_label",
    "machine_id", "machine_name",
)


def total_tokens() -> Column:
    """All tokens of an event. The 1h and 5m columns are parts of cache creation and never added."""
    total = F.col(TOKENS[0])
    for name in TOKENS[1:]:
        total = total + F.col(name)
    return total
