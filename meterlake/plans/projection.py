"""The ledger's tables, derived from the driver's tables; ``PREFIX`` is the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import chain_hashes, chain_head_hashes, command_hash, head
from ..functions.costs import RATES, micro_usd, price
from ..functions.identity import agent_name, hash_parts, project_label
from ..operators.api import merged_events
from ..operators.attribution import attribute
from ..operators.dedup import keep_highest, keep_highest_remote
from ..operators.tools import est_tokens, pair
from ..streaming.store import shared_folder

AS_OF = "2024-01-31T00:00:00Z"
SOURCES = ("claude_code", "codex", "opencode", "hermes")
MODELS = ("claude-opus-4-8", "claude-opus-4-1-x", "claude-sonnet-4-5", "gpt-5.1-codex-mini", "gpt-5.1-codex", "gpt-5.1", "gpt-5", "mystery-model-1")
TOOLS = ("Bash", "Read", "Edit", "Grep")
#: Command text by k % 10; behind it, what the normalizer must make of it: (segments, heads, the whole as one segment).
COMMANDS = (
    ("git status", ("git status",), ("git",), "git status"),
    ("rtk git status", ("git status",), ("git",), "git status"),
    ("FOO=1 rtk ls -la /tmp", ("ls -la /tmp",), ("ls",), "ls -la /tmp"),
    ("cd /srv && make test", ("cd /srv", "make test"), ("cd", "make"), "cd /srv && make test"),
    ('echo "a && b" | grep a', ("echo a && b", "grep a"), ("echo", "grep"), "echo a && b | grep a"),
    ("'/usr/bin/env' python x.py; ls", ("/usr/bin/env python x.py", "ls"), ("env", "ls"), "/usr/bin/env python x.py; ls"),
    ("rtk", ("",), (), ""),
    ("A=1 B=2", ("",), (), ""),
    ('cat "my file.txt" || true', ("cat my file.txt", "true"), ("cat", "true"), "cat my file.txt || true"),
    ("npm run build && npm test", ("npm run build", "npm test"), ("npm", "npm"), "npm run build && npm test"),
)


def _pick(n: str, values: tuple[str, ...]) -> str:
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return f"element_at(array({', '.join(chr(39) + v + chr(39) for v in quoted)}), CAST({n} AS INT) + 1)"


@dataclass
class Ledger:
    """Tables of one data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """One of these tables, written once, as a ledger has it: what reads it several times doesn't derive it again."""
        df = getattr(self, name)
        place = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    @cached_property
    def events(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("bigint")
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), stamp.alias("ts"))

    @cached_property
    def usage_raw(self) -> DataFrame:
        """Parsed events with their order of arrival, unpriced; every key comes twice."""
        project = F.expr("concat('/home/u', user_id % 5, '/proj', user_id % 12)")
        return self.events.filter("event_id % 10 <> 9").select(
            F.col("event_id").alias("ingest_seq"), F.expr(_pick("(event_id div 2) % 4", SOURCES)).alias("source"),
            F.expr("concat('m', event_id div 2)").alias("message_id"), F.lit("").alias("request_id"),
            F.expr("concat('s', user_id, '-', substring(ts, 1, 10))").alias("session_id"), "ts", F.expr(_pick("user_id % 8", MODELS)).alias("model"),
            F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"), F.col("k").alias("output_tokens"),
            F.expr("k * k").alias("cache_read_tokens"), F.expr("event_id % 500").alias("cache_creation_tokens"),
            F.expr("(event_id % 500) div 3").alias("cache_1h_tokens"), F.expr("(event_id % 500) div 4").alias("cache_5m_tokens"),
            F.expr("k % 7").alias("reasoning_tokens"), project.alias("project"), F.lit("1.0.0").alias("agent_version"),
            F.when(F.col("event_type") == "purchase", F.col("value") / 100).alias("cost_usd"),
            F.when(F.col("event_type") == "purchase", "logged").otherwise("estimated").alias("cost_basis"), project_label(project).alias("project_label"),
            F.expr("concat('mach', user_id % 3)").alias("machine_id"), F.expr("concat('host', event_id % 4)").alias("machine_name"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return keep_highest(price(self.usage_raw))

    @cached_property
    def remote_raw(self) -> DataFrame:
        """Records of other machines: event ids come twice or more."""
        return self.events.filter("event_id % 10 = 9").select(
            F.col("event_id").alias("server_seq"), F.expr("concat('r', event_id div 20)").alias("event_id"), "ts",
            agent_name(F.expr(_pick("event_id div 10 % 4", SOURCES))).alias("agent"), F.expr(_pick("user_id % 8", MODELS)).alias("model"),
            F.expr("concat('proj', user_id % 12)").alias("project_label"), F.expr("concat('s', user_id, '-', substring(ts, 1, 10))").alias("session_id"),
            F.expr("concat('far', user_id % 2)").alias("machine_id"), F.expr("concat('away', event_id % 3)").alias("machine_name"), F.lit("billed").alias("cost_basis"),
            F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"), F.col("k").alias("output_tokens"), F.lit(0).cast("bigint").alias("cache_read_tokens"),
            F.lit(0).cast("bigint").alias("cache_creation_tokens"), F.lit(0).cast("bigint").alias("reasoning_tokens"), micro_usd(F.col("value") / 1000).alias("est_cost_microusd"),
        )

    @cached_property
    def remote(self) -> DataFrame:
        return keep_highest_remote(self.remote_raw)

    @cached_property
    def merged(self) -> DataFrame:
        return merged_events(self.usage, self.remote)

    @cached_property
    def _turns(self) -> DataFrame:
        c = self.table("conversations")
        key = [F.lit("claude_code").alias("source"), F.expr("concat('c', conv_id)").alias("session_id")]
        ts = F.date_format(F.expr(f"timestamp '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, 0, 0, conv_id % 900 * 3600 - turn)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return c.select(*key, "conv_id", "turn", "role", ts.alias("ts"), F.octet_length("text").alias("n"))

    @cached_property
    def tool_uses(self) -> DataFrame:
        t = self._turns.filter("role = 'assistant'")
        return t.select(
            "source", "session_id", F.expr("concat('u', conv_id, '-', turn)").alias("tool_use_id"), "ts", F.lit("/srv").alias("project"),
            F.expr(_pick("turn % 4", TOOLS)).alias("tool_name"), est_tokens(F.col("n")).alias("est_args_tokens"), F.col("turn").alias("seq"),
        )

    @cached_property
    def tool_results(self) -> DataFrame:
        t = self._turns.filter("turn > 0")
        return t.select(
            "source", "session_id", F.expr("concat('u', conv_id, '-', turn - 1)").alias("tool_use_id"), "ts", est_tokens(F.col("n")).alias("est_result_tokens"),
            F.expr("turn % 5 = 0").alias("is_error"), F.col("turn").alias("seq"),
        )

    @cached_property
    def tool_events(self) -> DataFrame:
        return pair(self.tool_uses, self.tool_results)

    @cached_property
    def bash_events(self) -> DataFrame:
        command = F.expr(_pick("k % 10", tuple(c[0] for c in COMMANDS)))
        e = self.events.filter("event_type = 'click'")
        return e.select(
            F.col("event_id").alias("id"), F.expr(_pick("event_id % 4", SOURCES)).alias("source"), F.expr("concat('s', user_id, '-', substring(ts, 1, 10))").alias("session_id"), "ts",
            F.expr("concat('/home/u', user_id % 5, '/proj', user_id % 12)").alias("project"), command.alias("command"),
            chain_head_hashes(command).alias("head_hashes"), chain_hashes(command).alias("chain_hashes"),
        )

    @cached_property
    def savings_raw(self) -> DataFrame:
        command = F.expr(_pick("k % 10", tuple(c[0] for c in COMMANDS)))
        e, none = self.events.filter("event_type = 'view'"), F.lit(None).cast("string")
        return e.select(
            F.col("event_id").alias("rtk_row_id"), "ts", command_hash(command).alias("cmd_hash"), command_hash(head(command)).alias("head_hash"),
            F.expr("concat('/home/u', user_id % 5, '/proj', user_id % 12)").alias("project_path"), F.floor("value").cast("bigint").alias("saved_tokens"),
            none.alias("source"), none.alias("session_id"), F.lit(None).cast("bigint").alias("tool_event_id"), F.lit("none").alias("match_kind"),
        )

    @cached_property
    def savings(self) -> DataFrame:
        return attribute(self.savings_raw, self.bash_events)

    @cached_property
    def prefs(self) -> DataFrame:
        rows = [(f"proj{n}", f"renamed-{n}" if n % 3 == 0 else None, n % 5 == 4) for n in range(0, 12, 2)]
        return self.spark.createDataFrame(rows, "name string, synced_label string, excluded boolean")

    @cached_property
    def rollout_lines(self) -> DataFrame:
        """A file a user, in order of time: signups open a session, views set the model, all else counts tokens."""
        return self.events.select(
            F.expr("concat('f', user_id)").alias("file"), F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").alias("line_no"),
            F.expr("CASE event_type WHEN 'signup' THEN 'session_meta' WHEN 'view' THEN 'turn_context' ELSE 'token_count' END").alias("kind"),
            F.expr("CASE WHEN event_type = 'signup' THEN concat('sess', event_id) END").alias("meta_session"),
            F.expr("CASE WHEN event_type IN ('signup', 'view') AND k % 3 > 0 THEN concat('/w/p', k % 4) END").alias("cwd"),
            F.expr("CASE WHEN event_type = 'signup' THEN concat('0.', k % 10) END").alias("version"), F.expr("event_type = 'signup' AND k % 2 = 0").alias("replay_suspect"),
            F.expr(f"CASE WHEN event_type = 'view' THEN {_pick('k % 8', MODELS)} END").alias("model"),
            F.expr("CASE WHEN event_type NOT IN ('signup', 'view') THEN 'ok' END").alias("outcome"),
            F.expr("concat(substring(ts, 1, 15), '0:00Z')").alias("ts"), F.floor(F.col("value") * 10).cast("bigint").alias("input"), F.col("k").alias("cached"),
            F.expr("k % 50").alias("output"), F.expr("k % 5").alias("reasoning"), F.col("event_id").alias("cumulative"),
        )


def _sql_pick(n: str, values: tuple[str, ...]) -> str:
    return f"[{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][CAST({n} AS INT) + 1]"


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _list(items: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(f"sha256('{x}')" for x in items) + "] AS VARCHAR[])"


_TOTAL = "input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens + reasoning_tokens"
#: Table expressions of the ledger over the driver's tables, to put before a SELECT.
PREFIX = f"""
WITH rates(prefix, r_in, r_out, r_read, r_5m, r_1h) AS (VALUES {', '.join(f"('{p}', {', '.join(map(_double, r))})" for p, *r in RATES)}),
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events),
raw AS (SELECT event_id AS ingest_seq, {_sql_pick('(event_id // 2) % 4', SOURCES)} AS source, 'm' || (event_id // 2) AS message_id, '' AS request_id,
  's' || user_id || '-' || substr(ts, 1, 10) AS session_id, ts, {_sql_pick('user_id % 8', MODELS)} AS model, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
  k AS output_tokens, k * k AS cache_read_tokens, event_id % 500 AS cache_creation_tokens, (event_id % 500) // 3 AS cache_1h_tokens,
  (event_id % 500) // 4 AS cache_5m_tokens, k % 7 AS reasoning_tokens, '/home/u' || (user_id % 5) || '/proj' || (user_id % 12) AS project,
  CASE WHEN event_type = 'purchase' THEN value / 100 END AS given, 'proj' || (user_id % 12) AS project_label, 'mach' || (user_id % 3) AS machine_id,
  'host' || (event_id % 4) AS machine_name FROM ev WHERE event_id % 10 <> 9),
best_rate AS (SELECT model, r_in, r_out, r_read, r_5m, r_1h FROM (SELECT DISTINCT model FROM raw) JOIN rates ON starts_with(model, prefix)
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY length(prefix) DESC) = 1),
priced AS (SELECT raw.*, CASE WHEN given IS NOT NULL THEN 'logged' ELSE 'estimated' END AS cost_basis,
  CASE WHEN given IS NOT NULL THEN given ELSE CAST(input_tokens AS DOUBLE) * r_in + CAST(output_tokens AS DOUBLE) * r_out + CAST(cache_read_tokens AS DOUBLE) * r_read
    + CAST(cache_1h_tokens AS DOUBLE) * r_1h + (CAST(cache_5m_tokens AS DOUBLE) + greatest(CAST(cache_creation_tokens AS DOUBLE) - cache_1h_tokens - cache_5m_tokens, CAST(0 AS DOUBLE))) * r_5m END AS cost_usd
  FROM raw LEFT JOIN best_rate USING (model)),
usage AS (SELECT f.id, f.machine_id, f.machine_name, b.ingest_seq <> f.id AS dirty, b.* EXCLUDE (machine_id, machine_name)
  FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY source, message_id, request_id ORDER BY {_TOTAL} DESC, ingest_seq) = 1) b
  JOIN (SELECT source, message_id, request_id, min(ingest_seq) AS id, arg_min(machine_id, ingest_seq) AS machine_id, arg_min(machine_name, ingest_seq) AS machine_name
    FROM priced GROUP BY ALL) f USING (source, message_id, request_id)),
remote AS (SELECT event_id AS server_seq, 'r' || (event_id // 20) AS event_id, ts, replace({_sql_pick('(event_id // 10) % 4', SOURCES)}, '_', '-') AS agent,
  {_sql_pick('user_id % 8', MODELS)} AS model, 'proj' || (user_id % 12) AS project_label, 's' || user_id || '-' || substr(ts, 1, 10) AS session_id, 'far' || (user_id % 2) AS machine_id,
  'away' || (ev.event_id % 3) AS machine_name, 'billed' AS cost_basis, CAST(floor(value * 10) AS BIGINT) AS input_tokens, k AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
  CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(round(value / 1000 * 1000000) AS BIGINT) AS est_cost_microusd
  FROM ev WHERE ev.event_id % 10 = 9 QUALIFY row_number() OVER (PARTITION BY ev.event_id // 20 ORDER BY floor(value * 10) + k DESC, ev.event_id) = 1),
merged AS (SELECT source, session_id, ts, model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, reasoning_tokens, cost_basis,
    CAST(round(cost_usd * 1000000) AS BIGINT) AS est_cost_microusd, CASE WHEN cost_usd IS NULL THEN 1 ELSE 0 END AS unpriced, project_label, machine_id, machine_name,
    {_TOTAL} AS total, substr(ts, 1, 10) AS day FROM usage
  UNION ALL SELECT replace(agent, '-', '_'), session_id, ts, model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, reasoning_tokens, cost_basis, est_cost_microusd, 0,
    project_label, machine_id, machine_name, {_TOTAL}, substr(ts, 1, 10) FROM remote),
commands(n, chain, heads, whole, head) AS (VALUES {', '.join(f"({n}, {_list(c[1])}, {_list(c[2])}, sha256('{c[3]}'), sha256('{c[2][0] if c[2] else ''}'))" for n, c in enumerate(COMMANDS))}),
bash AS (SELECT event_id AS id, {_sql_pick('event_id % 4', SOURCES)} AS source, 's' || user_id || '-' || substr(ts, 1, 10) AS session_id, ts, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS e,
  '/home/u' || (user_id % 5) || '/proj' || (user_id % 12) AS project, chain, heads FROM ev JOIN commands ON n = k % 10 WHERE event_type = 'click'),
rtk AS (SELECT event_id AS rtk_row_id, ts, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS e, whole AS cmd_hash, head AS head_hash, '/home/u' || (user_id % 5) || '/proj' || (user_id % 12) AS project_path,
  CAST(floor(value) AS BIGINT) AS saved_tokens FROM ev JOIN commands ON n = k % 10 WHERE event_type = 'view'),
near AS (SELECT rtk_row_id, project_path, b.id, b.source, b.session_id, b.project, b.e AS be, abs(b.e - rtk.e) AS gap, list_contains(chain, cmd_hash) AS same, list_contains(heads, head_hash) AS same_head
  FROM rtk JOIN bash b ON b.e BETWEEN rtk.e - 120 AND rtk.e + 120),
tiers AS (SELECT rtk_row_id, count(*) FILTER (same) AS n_text, arg_min(id, gap * 1000000000 + id) FILTER (same) AS text_id, count(DISTINCT source || '|' || session_id) FILTER (same_head) AS n_heads,
  arg_min(id, gap * 1000000000 + id) FILTER (same_head) AS head_id, count(DISTINCT source || '|' || session_id) AS n_all, arg_min(id, gap * 1000000000 + id) AS any_id,
  arg_min(project, be * 1000000000 + id) = any_value(project_path) AS same_project FROM near GROUP BY rtk_row_id),
picked AS (SELECT rtk_row_id, CASE WHEN n_text > 0 THEN text_id WHEN n_heads = 1 THEN head_id WHEN n_all = 1 AND same_project THEN any_id END AS tool_event_id,
  CASE WHEN n_text > 0 THEN 'text' WHEN n_heads = 1 OR (n_all = 1 AND same_project) THEN 'window' ELSE 'none' END AS match_kind FROM tiers),
savings AS (SELECT rtk.rtk_row_id, rtk.ts, cmd_hash, head_hash, project_path, saved_tokens, bash.source, bash.session_id, tool_event_id, coalesce(match_kind, 'none') AS match_kind
  FROM rtk LEFT JOIN picked USING (rtk_row_id) LEFT JOIN bash ON bash.id = tool_event_id),
turns AS (SELECT 'claude_code' AS source, 'c' || conv_id AS session_id, conv_id, turn, role, octet_length(encode(text)) AS n,
  strftime(TIMESTAMP '2024-01-31 00:00:00' - to_seconds(conv_id % 900 * 3600 - turn), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM conversations),
tool_uses AS (SELECT source, session_id, 'u' || conv_id || '-' || turn AS tool_use_id, ts, {_sql_pick('turn % 4', TOOLS)} AS tool_name, CAST((n + 3) // 4 AS BIGINT) AS est_args_tokens, turn AS seq FROM turns WHERE role = 'assistant'),
tool_results AS (SELECT source, session_id, 'u' || conv_id || '-' || (turn - 1) AS tool_use_id, ts, CAST((n + 3) // 4 AS BIGINT) AS est_result_tokens, turn % 5 = 0 AS is_error, turn AS seq FROM turns WHERE turn > 0),
tool_events AS (SELECT u.source, u.session_id, u.tool_use_id, r.ts, tool_name, est_args_tokens, est_result_tokens, is_error FROM tool_uses u JOIN tool_results r USING (source, session_id, tool_use_id)),
prefs(name, synced_label, excluded) AS (VALUES {', '.join(f"('proj{n}', {f"'renamed-{n}'" if n % 3 == 0 else 'CAST(NULL AS VARCHAR)'}, {str(n % 5 == 4).lower()})" for n in range(0, 12, 2))})
"""
TOTAL_SQL = _TOTAL
__all__ = ["AS_OF", "COMMANDS", "Ledger", "PREFIX", "TOTAL_SQL", "hash_parts"]
