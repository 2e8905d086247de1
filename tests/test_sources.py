"""Logs and databases written by the tests, read through the sources: parsing, order, resuming, keep-highest, pairing."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from meterlake.sources import lines, rollouts, sqlite, transcripts
from meterlake.streaming import ingest, store


def turn(message, request, tokens, ts="2026-03-01T10:00:00.000Z", **top):
    usage = {"input_tokens": tokens, "output_tokens": 10, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 0}
    record = {"type": "assistant", "timestamp": ts, "sessionId": "s1", "requestId": request, "cwd": "/home/u/shop/", "version": "1.2.3"}
    return record | {"message": {"id": message, "model": "m-1", "usage": usage}} | top


def block(kind, ts="2026-03-01T10:00:00.000Z", **fields):
    return {"timestamp": ts, "sessionId": "s1", "cwd": "/p", "message": {"content": [{"type": kind, **fields}]}}


def write(path, records, tail=""):
    text = "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
    path.write_text(text + tail, encoding="utf-8")
    return str(path)


@pytest.fixture()
def read(spark):
    spark.dataSource.register(lines.AgentLines)
    return lambda root: spark.read.format("agent_lines").option("path", str(root)).load()


def test_lines_keep_their_places_and_the_last_open_one_waits(read, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "x.jsonl", ["é1", "", "three"], tail="unfinished")
    (tmp_path / "bad.jsonl").write_bytes(b"ok\n\xff\xfe\n")
    write(tmp_path / "history.jsonl", ["left out"])
    write(tmp_path / "notes.txt", ["left out"])
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.byte_offset, r.text) for r in read(tmp_path).collect())
    assert got == [("bad.jsonl", 0, 0, "ok"), ("bad.jsonl", 1, 3, None), ("x.jsonl", 0, 0, "é1"), ("x.jsonl", 1, 4, ""), ("x.jsonl", 2, 5, "three")]
    assert read(tmp_path / "nowhere").count() == 0


def test_a_stream_reads_what_changed(tmp_path):
    path = tmp_path / "a.jsonl"

    def look(text, tick):
        path.write_text(text)
        os.utime(path, ns=(tick, tick))
        return stream.latestOffset()

    stream = lines._Stream([str(tmp_path)])
    plan = lambda a, b: [(p.start, p.end) for p in stream.partitions(a, b)]
    zero, one = stream.initialOffset(), look("ab\ncd", 1)
    assert plan(zero, one) == [(0, 3)]
    two = look("ab\ncd\n", 2)
    assert plan(one, two) == [(3, 6)] and plan(two, two) == []
    three = look("xb\ncd\n", 3)  # rewritten at the same size
    assert plan(two, three) == [(0, 6)]
    assert plan(three, look("x\n", 4)) == [(0, 2)]
    assert plan(zero, look("no line break" * 200_000, 5)) == []
    opened = []
    stream._finished = lambda *a: opened.append(a) or 0
    stream.latestOffset()
    assert opened == []  # nothing changed


def test_transcript_outcomes(read, tmp_path):
    no_session, old = turn("m3", "r3", 1) | {"sessionId": ""}, turn("m4", "r4", 1) | {"version": "beta"}
    text_tokens, prompt = turn("m5", "r5", "7"), {"type": "user", "message": {"content": "hello"}}
    write(tmp_path / "t.jsonl", [turn("m1", "r1", 100), turn("m2", "r2", 7, costUSD=0.25), no_session, old, text_tokens, '{"usage": broken', prompt])
    rows = transcripts.usage_events(read(tmp_path)).orderBy("line_no").collect()
    assert [r.outcome for r in rows] == ["event", "event", "skip", "skip", "skip", "skip"]
    assert [(r.input_tokens, r.cost_usd, r.cost_basis, r.project) for r in rows[:2]] == [(100, None, "estimated", "/home/u/shop"), (7, 0.25, "logged", "/home/u/shop")]
    assert transcripts.scan_summary(transcripts.usage_events(read(tmp_path))).first().asDict() == {"events": 2, "lines_skipped": 4}


def test_tool_blocks(read, tmp_path):
    use = block("tool_use", id="t1", name="Bash", input={"command": "ls"})
    result = block("tool_result", tool_use_id="t1", content=[{"type": "text", "text": "abcde"}], is_error=True)
    write(tmp_path / "t.jsonl", [use, block("tool_use", id="t2", name="Read"), result, block("tool_result", tool_use_id="t9", content="é")])
    uses = transcripts.tool_uses(read(tmp_path)).orderBy("line_no").collect()
    assert [(u.tool_use_id, u.est_args_tokens, u.chain_hashes is not None) for u in uses] == [("t1", 4, True), ("t2", 1, False)]
    results = transcripts.tool_results(read(tmp_path)).orderBy("line_no").collect()
    assert [(r.tool_use_id, r.est_result_tokens, r.is_error) for r in results] == [("t1", 2, True), ("t9", 1, False)]


def test_a_followed_log_keeps_the_highest_version(spark, tmp_path):
    logs, folder, marks = tmp_path / "logs", str(tmp_path / "table"), str(tmp_path / "marks")
    logs.mkdir()
    half = json.dumps(turn("m3", "r3", 1000))
    first = [turn("m1", "r1", 100), turn("m1", "r1", 40), turn("m2", "r2", 7)]
    write(logs / "t.jsonl", first, tail=half[:50])
    ingest.ingest_transcripts(spark, str(logs), folder, marks).awaitTermination()
    table = store.Store(spark, folder)
    assert {r.message_id: r.input_tokens for r in table.read("usage").collect()} == {"m1": 100, "m2": 7}
    write(logs / "t.jsonl", [*first, turn("m3", "r3", 1000), turn("m2", "r2", 9), turn("m1", "r1", 100)])
    ingest.ingest_transcripts(spark, str(logs), folder, marks).awaitTermination()
    rows = table.read("usage")
    assert {r.message_id: r.input_tokens for r in rows.collect()} == {"m1": 100, "m2": 9, "m3": 1000}
    assert rows.select("id").distinct().count() == 3
    assert ingest.total_of(rows) == rows.agg(F.sum(F.col("input_tokens") + 15)).first()[0]


def meta(session, **more):
    return {"timestamp": "2026-03-01T10:00:00.000Z", "type": "session_meta", "payload": {"id": session, "cwd": "/w/app", "cli_version": "0.9.0", **more}}


def count(second, total, tokens=10):
    last = {"input_tokens": tokens, "cached_input_tokens": 4, "output_tokens": 2, "reasoning_output_tokens": 0}
    info = {"last_token_usage": last, "total_token_usage": {"total_tokens": total}}
    return {"timestamp": f"2026-03-01T10:00:{second:02d}.000Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_rollouts_carry_state_down_the_file(read, tmp_path):
    model = {"timestamp": "x", "type": "turn_context", "payload": {"model": "g-2", "cwd": "/w/lib"}}
    empty = {"timestamp": "2026-03-01T10:00:07.000Z", "type": "event_msg", "payload": {"type": "token_count", "info": None}}
    write(tmp_path / "r.jsonl", [count(1, 5), meta("s7"), count(2, 12), model, empty, count(8, 30), '{"token_count" broken'])
    records = rollouts.parse_lines(read(tmp_path))
    rows = rollouts.usage_events(records).orderBy("line_no").collect()
    assert [(r.session_id, r.request_id, r.model, r.project, r.input_tokens, r.cache_read_tokens) for r in rows] == [
        ("s7", "12", "unknown", "/w/app", 6, 4), ("s7", "30", "g-2", "/w/lib", 6, 4),
    ]
    assert rollouts.skipped(records).first().lines_skipped == 2  # no session yet; broken


def test_a_fork_leaves_its_replay_out(read, tmp_path):
    write(tmp_path / "f.jsonl", [meta("f", forked_from_id="s"), count(1, 10), count(1, 20), count(1, 30), count(9, 40)])
    write(tmp_path / "g.jsonl", [meta("g"), count(1, 10), count(1, 20)])
    rows = rollouts.usage_events(rollouts.parse_lines(read(tmp_path))).collect()
    assert sorted((r.session_id, r.request_id) for r in rows) == [("f", "40"), ("g", "10"), ("g", "20")]


def test_sqlite_tables_keep_what_values_are_stored_as(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id text primary key, n, note text)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [("a", 5, "é"), ("b", 2.9, None), ("c", "7", "x"), ("d", -3, "y"), ("e", None, "z")])
        db.execute("CREATE TABLE none (id integer)")
    t = sqlite.read_table(spark, path, "t", rowsPerPartition=2)
    assert t.rdd.getNumPartitions() == 3
    got = t.select(sqlite.text(t, "id").alias("id"), F.col("n.kind").alias("k"), sqlite.counter(t, "n").alias("n"), sqlite.text(t, "missing").alias("m")).orderBy("id").collect()
    assert [(r.id, r.k, r.n, r.m) for r in got] == [("a", "integer", 5, None), ("b", "real", 2, None), ("c", "text", 0, None), ("d", "integer", 0, None), ("e", "null", 0, None)]
    assert sqlite.read_table(spark, path, "none").count() == 0
    assert sqlite.table_stats(path, "t", "n")[0] == 5 and sqlite.table_columns(path, "nowhere") == []
