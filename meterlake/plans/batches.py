"""Registered queries that take the tables in batches: the ledger must then be what one pass makes of it, so the SQL is the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import price
from ..operators import api, cube, distinct, pages, windows
from ..operators.dedup import USAGE_KEY
from ..operators.tools import CALL
from ..sources import carried
from ..streaming import attributing, pairing
from ..streaming.scan import merge_usage
from ..streaming.store import Store, shared_folder
from .catalogue import _BY_SESSION, _NOW, _ROLLOUT, _SESSIONS, _SUMS, _micro, _plan, _query, _report
from .projection import MODELS, Ledger, _sql_pick


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _usage_store(t: Ledger, with_seconds: bool = False) -> Store:
    """The ledger after three commits: even events, odd ones (each the second version of a key), and all once more; beside the usage
    table the cells of its sums, which only learn what has changed."""
    spark, top = t.spark, _folder(t.spark, "usage")
    writer = Store(spark, top).writer()
    raw = price(t.usage_raw)

    def written(df: DataFrame) -> DataFrame:
        """What a change reads several times is computed once."""
        place = f"{top}/batches/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    for batch in (raw.filter("ingest_seq % 2 = 0"), raw.filter("ingest_seq % 2 = 1"), raw.withColumn("ingest_seq", F.col("ingest_seq") + (1 << 40))):
        change = writer.start()
        touched = change.upsert("usage", written(batch), USAGE_KEY, merge_usage, buckets=8)
        before = writer.store.read("usage", at=change.base, buckets=touched)
        changed = written(cube.delta(before, change.read("usage", touched)))
        change.upsert("cells", changed, cube.CELL, cube.add, buckets=8)
        if with_seconds:
            seconds = written(windows.delta(before, change.read("usage", touched)))
            change.upsert("seconds", seconds, windows.SECOND, windows.add, buckets=8)
        change.commit()
    return writer.store


_query("snk01_usage_store", f"""SELECT id, source, message_id, request_id, session_id, ts, model, {', '.join(_SUMS)}, CAST(round(cost_usd * 1000000) AS BIGINT) AS est_cost_microusd, dirty FROM usage""")(
    lambda t: _usage_store(t).read("usage").select("id", "source", "message_id", "request_id", "session_id", "ts", "model", *_SUMS, F.round(F.col("cost_usd") * 1_000_000).cast("bigint").alias("est_cost_microusd"), "dirty"))


def _windows_kept(t: Ledger) -> DataFrame:
    pulled = windows.seconds(t.merged.filter("machine_id LIKE 'far%'"))  # other machines' events, which come whole
    kept = windows.add(_usage_store(t, with_seconds=True).read("seconds"), pulled)
    return api.plan_windows(windows.as_events(kept), api.Filter(agent="codex"), _NOW, limits=(1_000_000, 1_000_000))


_query("str08_plan_windows_kept", _plan("cost_basis = 'estimated'"))(_windows_kept)
_query("str01_daily_kept", _report("substr(ts, 1, 10)"))(lambda t: _micro(cube.daily(_usage_store(t).read("cells"))))
_query("str01_sessions_kept", _report("session_id", "saved", join=_BY_SESSION))(lambda t: _micro(cube.sessions(_usage_store(t).read("cells"), t.savings)))


def _seen(t: Ledger) -> DataFrame:
    return pairing.seen(t.tool_uses, t.tool_results, F.col("seq").cast("bigint"))


#: Turns of the three batches: calls are cut between their use and their result.
_TURNS = ("seq < 2", "seq >= 2 AND seq < 5", "seq >= 5")
_EVENTS = ("source", "session_id", "tool_use_id", "ts", "tool_name", "est_args_tokens", "est_result_tokens", "is_error")


def _pairing_merged(t: Ledger) -> DataFrame:
    writer = Store(t.spark, _folder(t.spark, "calls")).writer()
    for turns in _TURNS:
        change = writer.start()
        change.upsert("calls", _seen(t).filter(turns), CALL, pairing.merge_calls, buckets=8)
        change.commit()
    return pairing.tool_events(writer.store.read("calls")).select(*_EVENTS)


def _pairing_streamed(t: Ledger) -> DataFrame:
    spark, top = t.spark, _folder(t.spark, "pairing")
    for turns in _TURNS:
        _seen(t).filter(turns).coalesce(1).write.mode("append").parquet(f"{top}/seen")
    was = {k: spark.conf.get(k, None) for k in pairing.SETTINGS}
    for k, v in pairing.SETTINGS.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(_seen(t).schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/seen")
        out = pairing.pair_stream(rows, None).writeStream.format("parquet").option("path", f"{top}/events").option("checkpointLocation", f"{top}/marks")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(pairing.EVENT).parquet(f"{top}/events").select(*_EVENTS)


_query("str03_pairing_merged", "SELECT * FROM tool_events")(_pairing_merged)
_query("str03_pairing_streamed", "SELECT * FROM tool_events")(_pairing_streamed)


def _rollout_scans(t: Ledger) -> DataFrame:
    """Every file in three scans, each in pieces of a few lines."""
    spark, top = t.spark, _folder(t.spark, "rollouts")
    t.rollout_lines.withColumns({"scan": F.expr("least(line_no div 25, 2)"), "piece": F.expr("line_no div 7")}).write.partitionBy("scan").parquet(f"{top}/lines")
    state = None
    for k in range(3):
        records = spark.read.parquet(f"{top}/lines/scan={k}")
        events, after = carried.usage_events(records, state)
        events.write.mode("append").parquet(f"{top}/events")
        after.write.parquet(f"{top}/state-{k}")
        state = spark.read.schema(carried.STATE).parquet(f"{top}/state-{k}")
    return spark.read.parquet(f"{top}/events")


_query("str06_rollout_scans", _ROLLOUT.replace("{models}", _sql_pick("k % 8", MODELS)))(
    lambda t: _rollout_scans(t).select("file", "line_no", "session_id", "request_id", "ts", "model", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens", "project", "agent_version"))


def _attribution_kept(t: Ledger) -> DataFrame:
    """Savings and events in four batches that mix times: a match found early may be withdrawn by an event that comes late."""
    spark, top = t.spark, _folder(t.spark, "attribution")
    writer = Store(spark, f"{top}/store").writer()
    t.bash_events.withColumn("part", F.expr("id % 4")).write.partitionBy("part").parquet(f"{top}/bash")
    t.savings_raw.withColumn("part", F.expr("rtk_row_id % 3")).write.partitionBy("part").parquet(f"{top}/savings")
    bash, savings = spark.read.parquet(f"{top}/bash"), spark.read.parquet(f"{top}/savings")
    for k in range(4):
        def write(df: DataFrame, name: str, k: int = k) -> DataFrame:
            place = f"{top}/{k}-{name}"
            df.write.parquet(place)
            return spark.read.schema(df.schema).parquet(place)

        change = writer.start()
        attributing.keep(change, savings.filter(F.col("part") == k).drop("part"), bash.filter(F.col("part") == k).drop("part", "command"), 0, write, buckets=8)
        change.commit()
    return writer.store.read("savings")


_query("str07_attribution_kept", "SELECT rtk_row_id, project_path, saved_tokens, source, session_id, tool_event_id, match_kind FROM savings")(
    lambda t: _attribution_kept(t).select("rtk_row_id", "project_path", "saved_tokens", "source", "session_id", "tool_event_id", "match_kind"))


def _bitmaps(t: Ledger) -> DataFrame:
    """Rows of all days, grown by two batches of events."""
    spark, top, numbers, known = t.spark, _folder(t.spark, "bitmaps"), None, None
    t.merged.select("ts", "source", "session_id", "project_label", "machine_id").write.parquet(f"{top}/merged")
    merged = spark.read.parquet(f"{top}/merged")
    for k, batch in enumerate((merged.filter("source IN ('codex', 'hermes')"), merged.filter("source NOT IN ('hermes')"))):
        distinct.dictionary(numbers, batch).write.parquet(f"{top}/numbers-{k}")
        numbers = spark.read.parquet(f"{top}/numbers-{k}")
        distinct.either(known, distinct.bitmaps(batch, numbers)).write.parquet(f"{top}/bits-{k}")
        known = spark.read.parquet(f"{top}/bits-{k}")
    return known


_COUNTS = "count(DISTINCT session_id) AS sessions, count(DISTINCT project_label) AS projects, count(DISTINCT machine_id) AS machines"
_query("agg06_distinct_bitmaps", f"SELECT {_COUNTS} FROM merged WHERE day BETWEEN '2024-01-10' AND '2024-01-25' AND source <> 'opencode'")(
    lambda t: distinct.counts(_bitmaps(t).filter("day BETWEEN '2024-01-10' AND '2024-01-25' AND source <> 'opencode'")))
_query("agg09_project_sessions_bitmaps", "SELECT project_label, count(DISTINCT session_id) AS sessions, count(DISTINCT machine_id) AS machines FROM merged GROUP BY project_label")(
    lambda t: distinct.counts(_bitmaps(t), "project_label").select("project_label", "sessions", "machines"))


_PAGE = [pages.Order("started_at", falling=True), pages.Order("session_id")]
_PAGE_COLUMNS = "session_id string, project_label string, machine_name string, started_at string, ended_at string, event_count bigint, total_tokens bigint, est_cost_microusd bigint, model string, agent string, rtk_saved_tokens bigint"


def _paged(t: Ledger, number: int) -> DataFrame:
    folder = _folder(t.spark, "pages")
    pages.lay_out(api.sessions(t.merged, t.savings, api.Filter()), folder, _PAGE, rows_per_range=200)
    return pages.page(t.spark, folder, _PAGE, _PAGE_COLUMNS, number, 50)


_query("ord03_page_by_seek", _SESSIONS.format(w="true") + " ORDER BY started_at DESC, session_id LIMIT 50 OFFSET 50")(lambda t: _paged(t, 2))
