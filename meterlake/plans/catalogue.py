"""Registered queries of the ledger over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, display, times
from ..functions.costs import prefix_counts, rate_card, unknown_models, with_rates
from ..functions.identity import hash_parts, project_label
from ..operators import api, reports, sync, tools
from ..operators.attribution import retry_candidates
from ..operators.dedup import keep_first, keep_last, upsert_outcomes
from ..operators.tools import CALL
from ..sources import rollouts
from .projection import AS_OF, COMMANDS, MODELS, PREFIX, TOTAL_SQL, Ledger, _sql_pick

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SINCE = "2024-01-20"
#: A filter that uses every field.
NARROW = api.Filter(project="proj3", machine="mach0", agent="codex", first="2024-01-03", last="2024-01-28")
DAYS = api.Filter(first="2024-01-10", last="2024-01-25")
_WHERE = {
    api.Filter(): "true", DAYS: "day BETWEEN '2024-01-10' AND '2024-01-25'",
    NARROW: "project_label = 'proj3' AND machine_id = 'mach0' AND source = 'codex' AND day BETWEEN '2024-01-03' AND '2024-01-28'",
}
_SUMS = "input_tokens output_tokens cache_read_tokens cache_creation_tokens reasoning_tokens".split()


def _query(name: str, sql: str | None = None, prefix: str = PREFIX) -> Callable[[Callable[[Ledger], DataFrame]], Callable[[Ledger], DataFrame]]:
    def add(f: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered")
        _QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            _SQL[name] = prefix + sql
        return f

    return add


def _micro(df: DataFrame) -> DataFrame:
    """Dollar sums to 9 digits: engines differ in the last bit of a decimal as a double."""
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if "cost_usd" in c and t == "double"})


def _report(key: str, saved: str = "CAST(NULL AS BIGINT)", where: str = "true", join: str = "") -> str:
    return f"""SELECT k AS key, g.* EXCLUDE (k, src), {saved} AS saved_tokens FROM (SELECT {key} AS k, min(source) AS src, count(*) AS events,
      {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS[:4])}, CAST(sum({TOTAL_SQL}) AS BIGINT) AS total_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 12))) AS DOUBLE), 9) AS cost_usd,
      count(*) FILTER (cost_usd IS NULL) AS unpriced_events FROM usage WHERE {where} GROUP BY {key}) g {join}"""


_BY_PROJECT = "LEFT JOIN (SELECT project_path, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM savings GROUP BY 1) s ON s.project_path = k"
_BY_SESSION = "LEFT JOIN (SELECT source, session_id, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM savings GROUP BY 1, 2) s ON s.session_id = k AND s.source = src"

_query("src21_rate_card", """SELECT prefix, r_in AS input, r_out AS output, r_read AS cache_read, r_5m AS cache_write_5m, r_1h AS cache_write_1h, coalesce(n, 0) AS events FROM rates LEFT JOIN (
  SELECT prefix, CAST(sum(n) AS BIGINT) AS n FROM (SELECT model, count(*) AS n FROM raw GROUP BY model) JOIN (SELECT model, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT model FROM raw) JOIN rates ON starts_with(model, prefix) GROUP BY model)
  USING (model) GROUP BY prefix) USING (prefix)""")(
    lambda t: rate_card(t.spark).join(prefix_counts(t.usage_raw), "prefix", "left").withColumn("events", F.coalesce("events", F.lit(0))))
_query("snk01_usage_ledger", f"""SELECT id, source, message_id, request_id, session_id, ts, model, {', '.join(_SUMS)}, cache_1h_tokens, cache_5m_tokens, project, cost_basis,
  CAST(round(cost_usd * 1000000) AS BIGINT) AS est_cost_microusd, project_label, machine_id, machine_name, dirty FROM usage""")(
    lambda t: t.usage.select("id", "source", "message_id", "request_id", "session_id", "ts", "model", *_SUMS, "cache_1h_tokens", "cache_5m_tokens", "project", "cost_basis",
                             F.round(F.col("cost_usd") * 1_000_000).cast("bigint").alias("est_cost_microusd"), "project_label", "machine_id", "machine_name", "dirty"))
_query("snk01_upsert_outcomes", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN before IS NULL THEN 'inserted' WHEN total > before THEN 'replaced_higher' ELSE 'kept_existing' END AS outcome
  FROM (SELECT total, max(total) OVER (PARTITION BY source, message_id, request_id ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {TOTAL_SQL} AS total FROM priced))) GROUP BY outcome""")(
    lambda t: upsert_outcomes(t.usage_raw).groupBy("outcome").agg(F.count("*").alias("n")))
_query("snk02_remote_ledger", "SELECT * FROM remote")(lambda t: t.remote)
_query("jn01_longest_prefix", "SELECT model, r_in AS input, r_out AS output FROM (SELECT DISTINCT model FROM raw) LEFT JOIN best_rate USING (model)")(
    lambda t: with_rates(t.usage_raw.select("model").distinct()).select("model", F.col("rate.input").alias("input"), F.col("rate.output").alias("output")))
_query("agg20_unknown_models", "SELECT DISTINCT model FROM priced WHERE cost_usd IS NULL")(lambda t: unknown_models(t.usage_raw))
_query("agg01_daily", _report("substr(ts, 1, 10)"))(lambda t: _micro(reports.daily(t.usage)))
_query("agg01_daily_since", _report("substr(ts, 1, 10)", where=f"ts >= '{SINCE}'"))(lambda t: _micro(reports.daily(reports.since(t.usage, SINCE))))
_query("agg02_models", _report("model"))(lambda t: _micro(reports.models(t.usage)))
_query("agg03_projects", _report("project", "saved", join=_BY_PROJECT))(lambda t: _micro(reports.projects(t.usage, t.savings)))
_query("agg04_sessions", _report("session_id", "saved", join=_BY_SESSION))(lambda t: _micro(reports.sessions(t.usage, t.savings)))
_TOTALS = f"""count(*) AS events, CAST(coalesce(sum({TOTAL_SQL}), 0) AS BIGINT) AS total_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 12))) AS DOUBLE), 9) AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced_events,
  count(DISTINCT session_id) AS sessions, min(substr(ts, 1, 10)) AS first_day"""
_query("agg05_totals", f"SELECT {_TOTALS} FROM usage")(lambda t: _micro(reports.totals(t.usage)))
_query("agg05_totals_since", f"SELECT {_TOTALS} FROM usage WHERE ts >= '{SINCE}'")(lambda t: _micro(reports.totals(reports.since(t.usage, SINCE))))
_query("set01_merged_events", "SELECT * EXCLUDE (total, day) REPLACE (CAST(unpriced AS BIGINT) AS unpriced) FROM merged")(lambda t: t.merged)


def _filtered(name: str, sql: Callable[[str], str], f: Callable[[Ledger, api.Filter], DataFrame]) -> None:
    for kind, flt in (("", api.Filter()), ("_days", DAYS), ("_narrow", NARROW)):
        _query(name + kind, sql(_WHERE[flt]))(lambda t, flt=flt: f(t, flt))


_TODAY = "day = '2024-01-31'"
_filtered("agg06_summary", lambda w: f"""SELECT total AS total_tokens, sub + api AS est_cost_microusd, CASE WHEN mode = 'api' THEN 'estimated spend' ELSE 'API-equivalent value' END AS cost_label,
  mode AS billing_mode, mode <> 'api' AS plan_window_applicable, today_tokens, today_est_cost_microusd, CASE WHEN total > 0 THEN reads / CAST(total AS DOUBLE) ELSE 0.0 END AS cache_read_ratio,
  project_count, machine_count, since, sub AS subscription_microusd, api AS api_microusd FROM (SELECT *, CASE WHEN n_api > 0 AND n_sub > 0 THEN 'mixed' WHEN n_api > 0 THEN 'api' ELSE 'subscription' END AS mode FROM (
  SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS reads, CAST(coalesce(sum(est_cost_microusd) FILTER (cost_basis = 'estimated'), 0) AS BIGINT) AS sub,
  CAST(coalesce(sum(est_cost_microusd) FILTER (cost_basis IN ('logged', 'billed')), 0) AS BIGINT) AS api, count(*) FILTER (cost_basis = 'estimated') AS n_sub, count(*) FILTER (cost_basis IN ('logged', 'billed')) AS n_api,
  count(DISTINCT project_label) AS project_count, count(DISTINCT machine_id) AS machine_count, min(day) AS since, CAST(coalesce(sum(total) FILTER ({_TODAY}), 0) AS BIGINT) AS today_tokens,
  CAST(coalesce(sum(est_cost_microusd) FILTER ({_TODAY}), 0) AS BIGINT) AS today_est_cost_microusd FROM merged WHERE {w}))""", lambda t, f: api.summary(t.merged, f, AS_OF))  # fmt: skip
_USAGE = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS) + ", CAST(sum(total) AS BIGINT) AS total_tokens, CAST(coalesce(sum(est_cost_microusd), 0) AS BIGINT) AS est_cost_microusd"
_SHARE = "CASE WHEN sum(sum(total)) OVER () > 0 THEN CAST(sum(total) AS DOUBLE) / CAST(sum(sum(total)) OVER () AS DOUBLE) ELSE 0.0 END AS share"
_filtered("agg07_api_models", lambda w: f"SELECT model, {_USAGE}, CAST(sum(unpriced) AS BIGINT) AS unpriced_events, {_SHARE} FROM merged WHERE {w} GROUP BY model", lambda t, f: api.by_model(t.merged, f))
_filtered("agg08_api_agents", lambda w: f"SELECT replace(source, '_', '-') AS agent, {_USAGE}, CAST(sum(unpriced) AS BIGINT) AS unpriced_events, {_SHARE} FROM merged WHERE {w} GROUP BY source", lambda t, f: api.by_agent(t.merged, f))
_filtered("agg09_api_projects", lambda w: f"""SELECT project_label, CAST(sum(total) AS BIGINT) AS total_tokens, CAST(coalesce(sum(est_cost_microusd), 0) AS BIGINT) AS est_cost_microusd, count(DISTINCT session_id) AS session_count,
  {_SHARE} FROM merged WHERE {w} GROUP BY project_label""", lambda t, f: api.by_project(t.merged, f))  # fmt: skip
_filtered("agg10_api_daily", lambda w: f"SELECT day AS date, model, {_USAGE} FROM merged WHERE {w} GROUP BY day, model", lambda t, f: api.daily_models(t.merged, f))
_query("agg10_api_daily_nested", """SELECT date, CAST(sum(n) AS BIGINT) AS total_tokens, CAST(sum(cost) AS BIGINT) AS est_cost_microusd, string_agg(model || ':' || n || ':' || cost, ',' ORDER BY n DESC, model) AS models
  FROM (SELECT day AS date, model, CAST(sum(total) AS BIGINT) AS n, CAST(coalesce(sum(est_cost_microusd), 0) AS BIGINT) AS cost FROM merged GROUP BY day, model) GROUP BY date""")(
    lambda t: api.daily(t.merged, api.Filter()).select("date", "total_tokens", "est_cost_microusd", F.array_join(F.transform("by_model", lambda x: F.concat_ws(":", x["model"], x["total_tokens"], x["est_cost_microusd"])), ",").alias("models")))
_filtered("agg11_heatmap", lambda w: f"""SELECT date, total_tokens, est_cost_microusd, CAST(CASE WHEN total_tokens <= 0 OR most <= 0 THEN 0 WHEN total_tokens * 4 >= most * 3 THEN 4 WHEN total_tokens * 2 >= most THEN 3
  WHEN total_tokens * 4 >= most THEN 2 ELSE 1 END AS INTEGER) AS level, most AS max_tokens, '2024-01-01' AS horizon FROM (SELECT day AS date, CAST(sum(total) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(est_cost_microusd), 0) AS BIGINT) AS est_cost_microusd, CAST(max(sum(total)) OVER () AS BIGINT) AS most FROM merged WHERE {w} AND day >= '2023-02-01' GROUP BY day)""", lambda t, f: api.heatmap(t.merged, f, AS_OF))  # fmt: skip
_SESSIONS = """SELECT m.*, r.rtk_saved_tokens FROM (SELECT session_id, max(project_label) AS project_label, max(machine_name) AS machine_name, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count,
  CAST(sum(total) AS BIGINT) AS total_tokens, CAST(coalesce(sum(est_cost_microusd), 0) AS BIGINT) AS est_cost_microusd, CASE WHEN count(DISTINCT model) > 1 THEN 'mixed' ELSE max(model) END AS model,
  replace(max(source), '_', '-') AS agent FROM merged WHERE {w} GROUP BY session_id) m LEFT JOIN (SELECT session_id, CAST(sum(saved_tokens) AS BIGINT) AS rtk_saved_tokens FROM savings WHERE session_id IS NOT NULL GROUP BY 1) r USING (session_id)"""
_filtered("agg12_api_sessions", lambda w: _SESSIONS.format(w=w), lambda t, f: api.sessions(t.merged, t.savings, f))
_query("ord03_session_page", _SESSIONS.format(w="true") + " ORDER BY started_at DESC, session_id LIMIT 50 OFFSET 50")(lambda t: api.session_page(t.merged, t.savings, api.Filter(), 2, 50)[0])
_query("ord03_session_count", "SELECT count(DISTINCT session_id) AS total FROM merged")(lambda t: api.session_page(t.merged, t.savings, api.Filter())[1])
_filtered("agg13_mode_counts", lambda w: f"SELECT count(*) FILTER (cost_basis = 'estimated') AS subscription_events, count(*) FILTER (cost_basis IN ('logged', 'billed')) AS api_events FROM merged WHERE {w}", lambda t, f: api.mode_counts(f.apply(t.merged)))
_query("fn19_mode_breakdown", """SELECT * FROM (SELECT 'subscription' AS billing_mode, CAST(sum(est_cost_microusd) FILTER (cost_basis = 'estimated') AS BIGINT) AS est_cost_microusd, 'API-equivalent value' AS cost_label FROM merged
  UNION ALL SELECT 'api', CAST(sum(est_cost_microusd) FILTER (cost_basis IN ('logged', 'billed')) AS BIGINT), 'estimated spend' FROM merged)""")(lambda t: api.mode_breakdown(t.merged, api.Filter(), AS_OF))  # fmt: skip
_NOW = "2024-01-30T12:00:00Z"


def _plan(basis: str) -> str:
    spans = (("rolling_5h", 5), ("weekly", 168))
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "window", {h} AS window_hours, CAST(coalesce(sum(total) FILTER (e >= now - {h * 3600} AND e <= now), 0) AS BIGINT) AS tokens_used, CAST(1000000 AS BIGINT) AS limit_tokens,
        coalesce(sum(total) FILTER (e >= now - {h * 3600} AND e <= now), 0) / CAST(1000000 AS DOUBLE) AS utilization,
        strftime(make_timestamp((coalesce(min(e) FILTER (e >= now - {h * 3600} AND e <= now), any_value(now)) + {h * 3600}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS resets_at, true AS applicable
        FROM (SELECT total, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS e, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') AS BIGINT) AS now FROM merged WHERE source = 'claude_code' AND {basis} AND day >= '2024-01-22')"""
        for n, h in spans
    )


_query("win05_plan_windows", _plan("cost_basis = 'estimated'"))(lambda t: api.plan_windows(t.merged, api.Filter(agent="codex"), _NOW, limits=(1_000_000, 1_000_000)))
_query("win05_plan_windows_override", _plan("true"))(lambda t: api.plan_windows(t.merged, api.Filter(), _NOW, limits=(1_000_000, 1_000_000), override="subscription"))
_query("win05_rolling_usage", f"""SELECT id, CAST(sum({TOTAL_SQL}) OVER (PARTITION BY source ORDER BY e RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_tokens
  FROM (SELECT *, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS e FROM usage)""")(lambda t: api.rolling_usage(t.usage, 18000).select("id", "rolling_tokens"))  # fmt: skip
_query("win09_bar_widths", """SELECT project_label, CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () ELSE 0.0 END AS width FROM (SELECT project_label, CAST(sum(total) AS DOUBLE) / CAST(sum(sum(total)) OVER () AS DOUBLE) AS s
  FROM merged GROUP BY project_label)""")(lambda t: api.relative_shares(api.by_project(t.merged, api.Filter())).select("project_label", "width"))  # fmt: skip
_query("jn02_tool_events", "SELECT * FROM tool_events")(lambda t: t.tool_events.select("source", "session_id", "tool_use_id", "ts", "tool_name", "est_args_tokens", "est_result_tokens", "is_error"))
_query("jn02_pending", "SELECT source, session_id, tool_use_id, ts, tool_name FROM tool_uses ANTI JOIN tool_events USING (source, session_id, tool_use_id)")(
    lambda t: tools.pending(t.tool_uses, t.tool_events).select("source", "session_id", "tool_use_id", "ts", "tool_name"))
_query("snk04_last_use_wins", "SELECT session_id, tool_name, max(seq) AS seq FROM tool_uses GROUP BY 1, 2")(lambda t: keep_last(t.tool_uses, ("session_id", "tool_name"), "seq").select("session_id", "tool_name", "seq"))
_query("snk05_first_result_wins", """SELECT source, session_id, tool_use_id, min(seq) AS seq, arg_min(est_result_tokens, seq) AS est_result_tokens FROM (
  SELECT * FROM tool_results UNION ALL SELECT source, session_id, tool_use_id, ts, est_result_tokens + 1, is_error, seq + 1000 FROM tool_results) GROUP BY 1, 2, 3""")(
    lambda t: keep_first(_repeated(t.tool_results), CALL, "seq").select(*CALL, F.col("seq").cast("bigint").alias("seq"), "est_result_tokens"))
_query("snk06_pending_pruned", "SELECT count(*) AS pending FROM (SELECT * FROM tool_uses ANTI JOIN tool_events USING (source, session_id, tool_use_id)) WHERE substr(ts, 1, 10) >= '2024-01-01'")(
    lambda t: tools.prune(tools.pending(t.tool_uses, t.tool_events), AS_OF).agg(F.count("*").alias("pending")))


def _repeated(results: DataFrame) -> DataFrame:
    """Every result and a later one of the same call."""
    later = results.withColumns({"seq": F.col("seq") + 1000, "est_result_tokens": F.col("est_result_tokens") + 1})
    return later.unionByName(results)


def _by_tool(where: str) -> str:
    return f"""SELECT *, CASE WHEN sum(est_total_tokens) OVER () > 0 THEN CAST(100 AS DOUBLE) * est_total_tokens / CAST(sum(est_total_tokens) OVER () AS DOUBLE) ELSE 0.0 END AS share_pct FROM (SELECT tool_name, count(*) AS calls,
      CAST(sum(est_args_tokens) AS BIGINT) AS est_args_tokens, CAST(sum(est_result_tokens) AS BIGINT) AS est_result_tokens, CAST(sum(est_args_tokens + est_result_tokens) AS BIGINT) AS est_total_tokens
      FROM tool_events WHERE {where} GROUP BY tool_name)"""


_query("agg14_tools", _by_tool("true"))(lambda t: tools.by_tool(t.tool_events))
_query("flt04_tools_days", _by_tool("substr(ts, 1, 10) >= '2024-01-24'"))(lambda t: tools.by_tool(tools.filtered(t.tool_events, days=7, as_of=AS_OF)))
_query("flt04_tools_session", _by_tool("session_id = 'c3'"))(lambda t: tools.by_tool(tools.filtered(t.tool_events, session="c3")))
_query("agg15_savings_totals", "SELECT count(*) AS commands, CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS saved_tokens FROM savings HAVING count(*) > 0")(lambda t: tools.savings_totals(t.savings))
_query("agg15_savings_none", "SELECT count(*) AS commands, CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS saved_tokens FROM savings WHERE session_id = 'nobody' HAVING count(*) > 0")(
    lambda t: tools.savings_totals(tools.filtered(t.savings, session="nobody")))
_query("jn07_attribution", "SELECT rtk_row_id, ts, project_path, saved_tokens, source, session_id, tool_event_id, match_kind FROM savings")(
    lambda t: t.savings.select("rtk_row_id", "ts", "project_path", "saved_tokens", "source", "session_id", "tool_event_id", "match_kind"))
_query("str07_retry_candidates", """SELECT rtk_row_id, ts FROM savings WHERE match_kind = 'none' AND (rtk_row_id > 5000 OR epoch(CAST(ts AS TIMESTAMP)) > epoch(TIMESTAMP '2024-01-29 00:00:00'))""")(
    lambda t: retry_candidates(t.savings, 5000, times.to_epoch(AS_OF)).select("rtk_row_id", "ts"))
_query("ord07_unattributed", "SELECT rtk_row_id FROM savings WHERE match_kind = 'none'")(lambda t: t.savings.filter("match_kind = 'none'").orderBy("rtk_row_id").select("rtk_row_id"))
_query("fn10_chain_hashes", f"SELECT id, array_to_string(chain, ',') AS chain, array_to_string(heads, ',') AS heads FROM bash")(
    lambda t: t.bash_events.select("id", F.array_join("chain_hashes", ",").alias("chain"), F.array_join("head_hashes", ",").alias("heads")))
_query("fn12_normalize", f"SELECT event_id AS id, w AS normalized, h AS head FROM ev JOIN (VALUES {', '.join(f'''({n}, '{c[3]}', '{c[2][0] if c[2] else ''}')''' for n, c in enumerate(COMMANDS))}) c(n, w, h) ON n = k % 10 WHERE event_type = 'click'")(
    lambda t: t.bash_events.select("id", commands.normalize(F.col("command")).alias("normalized"), commands.head(F.col("command")).alias("head")))


def _savings(flt: api.Filter) -> str:
    w, days = _WHERE[flt], "true" if flt.first is None else f"substr(ts, 1, 10) BETWEEN '{flt.first}' AND '{flt.last}'"
    other = "CAST(NULL AS BIGINT)" if flt.project else f"(SELECT CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) FROM savings WHERE match_kind = 'none' AND {days})"
    return f"""SELECT c AS consumed_tokens, s AS saved_attributed, {other} AS saved_unattributed, n AS commands, CASE WHEN c > 0 THEN s / CAST(c AS DOUBLE) END AS savings_ratio, true AS rtk_present
      FROM (SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS c FROM merged WHERE {w}), (SELECT CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS s, count(*) AS n FROM savings
      WHERE match_kind <> 'none' AND {days} AND session_id IN (SELECT session_id FROM merged WHERE {w}))"""


def _savings_daily(flt: api.Filter) -> str:
    w, days = _WHERE[flt], "true" if flt.first is None else f"substr(ts, 1, 10) BETWEEN '{flt.first}' AND '{flt.last}'"
    return f"""SELECT date, CAST(coalesce(c, 0) AS BIGINT) AS consumed, CAST(coalesce(s, 0) AS BIGINT) AS saved FROM (SELECT day AS date, sum(total) AS c FROM merged WHERE {w} GROUP BY 1)
      FULL JOIN (SELECT substr(ts, 1, 10) AS date, sum(saved_tokens) AS s FROM savings WHERE match_kind <> 'none' AND {days} AND session_id IN (SELECT session_id FROM merged WHERE {w}) GROUP BY 1) USING (date)"""


for _kind, _flt in (("", api.Filter()), ("_days", DAYS), ("_narrow", NARROW)):
    _query(f"agg16_savings_window{_kind}", _savings(_flt))(lambda t, f=_flt: api.savings_window(t.stored("merged"), t.stored("savings"), f))
    _query(f"agg17_savings_daily{_kind}", _savings_daily(_flt))(lambda t, f=_flt: api.savings_daily(t.stored("merged"), t.stored("savings"), f))
_query("agg18_machines", """SELECT machine_id, max(ts) AS last_seen, count(*) AS event_count, arg_max(label, ts) AS label, machine_id = 'mach0' AS is_current FROM (SELECT machine_id, ts, max(machine_name) OVER (PARTITION BY machine_id, ts) AS label FROM merged)
  GROUP BY machine_id""")(lambda t: sync.machines(t.merged, "mach0").withColumnRenamed("machine_name", "label"))  # fmt: skip
_PREF = "usage u LEFT JOIN prefs ON name = coalesce(project_label, project)"
_query("agg19_pending_push", f"SELECT count(*) AS pending FROM {_PREF} WHERE id > 4000 AND NOT coalesce(excluded, false)")(lambda t: sync.pending_count(t.usage, t.prefs, 4000))
_query("set03_to_push", "SELECT id, dirty FROM usage WHERE id > 4000 OR dirty")(lambda t: sync.to_push(t.usage, 4000).select("id", "dirty"))
_query("ord05_next_batch", "SELECT id FROM usage WHERE id > 4000 OR dirty ORDER BY id LIMIT 1000")(lambda t: sync.next_batch(t.usage, 4000).select("id"))
_RECORD = """SELECT id, sha256(concat_ws(chr(31), source, message_id, request_id)) AS event_id, ts, replace(source, '_', '-') AS agent, substr(model, 1, 100) AS model, substr(coalesce(synced_label, project_label), 1, 120) AS project_label,
  sha256(session_id) AS session_id, machine_id, substr(machine_name, 1, 64) AS machine_name, least(input_tokens, 100000000) AS input_tokens, least(output_tokens, 100000000) AS output_tokens,
  least(cache_read_tokens, 100000000) AS cache_read_tokens, least(cache_creation_tokens, 100000000) AS cache_creation_tokens, least(reasoning_tokens, output_tokens) AS reasoning_tokens,
  CAST(CASE WHEN cost_usd > 0 THEN least(round(cost_usd * 1000000), 10000000000) ELSE 0 END AS BIGINT) AS est_cost_microusd, cost_basis FROM """
_query("prj04_records", f"{_RECORD} {_PREF} WHERE NOT coalesce(excluded, false)")(lambda t: sync.records(t.usage, t.prefs))
_query("ord06_preview", f"{_RECORD} {_PREF} ORDER BY id LIMIT 1")(lambda t: sync.preview(t.usage, t.prefs))
_query("jn11_review", "SELECT name, synced_label, coalesce(excluded, false) AS excluded FROM (SELECT DISTINCT coalesce(project_label, project) AS name FROM usage) LEFT JOIN prefs USING (name)")(lambda t: sync.review(t.usage, t.prefs))
_query("set02_labels", "SELECT DISTINCT coalesce(project_label, project) AS name FROM usage")(lambda t: sync.labels(t.usage))
_TOP = "SELECT {k} FROM usage WHERE ts >= '2024-01-01' GROUP BY {k} ORDER BY coalesce(sum(CAST(cost_usd AS DECIMAL(28, 12))), 0) DESC, sum(" + TOTAL_SQL + ") DESC, {k} LIMIT 1"
_query("agg21_overview", f"""SELECT * FROM (SELECT count(*) AS window_events, CAST(sum({TOTAL_SQL}) AS BIGINT) AS window_total_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 12))) AS DOUBLE), 9) AS window_cost_usd, count(DISTINCT session_id) AS window_sessions FROM usage WHERE ts >= '2024-01-01'),
  (SELECT count(*) AS today_events, CAST(coalesce(sum({TOTAL_SQL}), 0) AS BIGINT) AS today_total_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 12))) AS DOUBLE), 9) AS today_cost_usd, count(DISTINCT session_id) AS today_sessions FROM usage WHERE ts >= '2024-01-31'),
  (SELECT ({_TOP.format(k='model')}) AS top_model, ({_TOP.format(k='project')}) AS top_project)""")(lambda t: _micro(reports.overview(t.usage, t.savings, AS_OF)))  # fmt: skip
_query("ord04_top_model", f"SELECT ({_TOP.format(k='model')}) AS top_model")(lambda t: reports.top_by_cost(reports.models(reports.since(t.usage, "2024-01-01"))).select(F.col("key").alias("top_model")))
_query("agg22_model_order", "SELECT model, CAST(sum(total) AS BIGINT) AS total_tokens FROM merged GROUP BY model")(lambda t: api.model_order(t.merged))
_query("agg23_token_kinds_daily", f"SELECT day AS date, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, CAST(sum(total) AS BIGINT) AS total_tokens FROM merged GROUP BY day")(lambda t: api.token_kinds_daily(t.merged))
_query("fn22_calendar", """SELECT strftime(d, '%Y-%m-%d') AS date, CAST(date_diff('day', DATE '2023-01-29', d) // 7 AS INTEGER) AS col, CAST(dayofweek(d) AS INTEGER) AS "row", CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens, CAST(coalesce(level, 0) AS INTEGER) AS level
  FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-29', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT day, total_tokens, CASE WHEN total_tokens <= 0 THEN 0 WHEN total_tokens * 4 >= most * 3 THEN 4 WHEN total_tokens * 2 >= most THEN 3
  WHEN total_tokens * 4 >= most THEN 2 ELSE 1 END AS level FROM (SELECT day, sum(total) AS total_tokens, max(sum(total)) OVER () AS most FROM merged GROUP BY day)) h ON h.day = strftime(d, '%Y-%m-%d')""")(
    lambda t: api.calendar(api.heatmap(t.merged, api.Filter(), AS_OF), AS_OF))
_query("fn05_hash_parts", "SELECT event_id, sha256(concat_ws(chr(31), event_type, CAST(user_id AS VARCHAR))) AS h FROM ev")(lambda t: t.events.select("event_id", hash_parts(F.col("event_type"), F.col("user_id").cast("string")).alias("h")))
_query("fn06_epoch", "SELECT event_id, CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT) AS e, ts AS back FROM ev")(
    lambda t: t.events.select("event_id", times.epoch(F.col("ts")).alias("e"), times.rfc3339(times.epoch(F.col("ts"))).alias("back")))
_query("prj02_project_label", "SELECT DISTINCT project, regexp_extract(project, '[^/]*$') AS label FROM raw")(lambda t: t.usage_raw.select("project", project_label(F.col("project")).alias("label")).distinct())
_query("fn20_display", """SELECT event_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE regexp_replace(printf('%.1f', n / CAST(1000 AS DOUBLE)), '\\.0$', '') || 'K' END AS tokens_text, n FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) * 2 + 1 AS n FROM ev)""")(
    lambda t: t.events.select("event_id", (F.floor(F.col("value") * 100) * 2 + 1).cast("bigint").alias("n")).withColumn("tokens_text", display.tokens_text(F.col("n"))))

_ROLLOUT = """, lines AS (SELECT 'f' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_type, event_id, k, value, substr(ts, 1, 15) || '0:00Z' AS t FROM ev),
state AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS segment, last_value(CASE WHEN event_type = 'signup' THEN 'sess' || event_id END IGNORE NULLS) OVER w AS session_id,
  coalesce(last_value(CASE WHEN event_type = 'view' THEN {models} END IGNORE NULLS) OVER w, 'unknown') AS model, coalesce(last_value(CASE WHEN event_type IN ('signup', 'view') AND k % 3 > 0 THEN '/w/p' || (k % 4) END IGNORE NULLS) OVER w, '') AS project,
  coalesce(last_value(CASE WHEN event_type = 'signup' THEN '0.' || (k % 10) END IGNORE NULLS) OVER w, '') AS agent_version, last_value(CASE WHEN event_type = 'signup' THEN k % 2 = 0 END IGNORE NULLS) OVER w AS flagged
  FROM lines WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand AS (SELECT *, lag(t) OVER (PARTITION BY file, segment ORDER BY line_no) AS prev, last_value(t) OVER (PARTITION BY file, segment ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM state WHERE event_type NOT IN ('signup', 'view') AND session_id IS NOT NULL),
judged AS (SELECT *, arg_min(t, line_no) FILTER (prev = t) OVER s AS replay, max(line_no) FILTER (t <> final) OVER s AS last_diff FROM cand WINDOW s AS (PARTITION BY file, segment)),
kept AS (SELECT * FROM judged WHERE NOT flagged OR (replay IS NOT NULL AND t <> replay) OR (replay IS NULL AND line_no <= coalesce(last_diff, -1)))
SELECT file, line_no, session_id, CAST(event_id AS VARCHAR) AS request_id, t AS ts, model, greatest(CAST(floor(value * 10) AS BIGINT) - k, 0) AS input_tokens, k % 50 AS output_tokens, k AS cache_read_tokens, k % 5 AS reasoning_tokens, project, agent_version FROM kept"""
_query("src09_rollout_events", _ROLLOUT.replace("{models}", _sql_pick("k % 8", MODELS)))(
    lambda t: rollouts.usage_events(t.rollout_lines).select("file", "line_no", "session_id", "request_id", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens", "project", "agent_version"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by day, from raw events through pricing and keep-higher."""
    return _QUERIES["agg01_daily"](spark, sf_dir)


from . import batches  # noqa: E402, F401  registers queries of its own
