"""Attribution kept over batches, messages that wait, rows of the databases, distinct counts by bitmaps."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterlake.operators import api, distinct, windows
from meterlake.operators.attribution import attribute
from meterlake.plans.schema import TOKENS
from meterlake.sources import databases, sqlite
from meterlake.streaming import attributing, gate, scan

BASH = "id bigint, source string, session_id string, ts string, project string, head_hashes array<string>, chain_hashes array<string>"
ROWS = (
    "rtk_row_id bigint, ts string, cmd_hash string, head_hash string, project_path string, saved_tokens bigint, source string, session_id string, "
    "tool_event_id bigint, match_kind string"
)


def stamp(s):
    return f"2026-03-01T{10 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_as_one_pass(spark, tmp_path, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("abc")
    bash = [(k, "c", f"s{rng.randrange(3)}", stamp(rng.randrange(9000)), rng.choice(["/p", "/q"]), [name()], [name()]) for k in range(60)]
    rows = [(k, stamp(rng.randrange(9000)), name(), name(), rng.choice(["/p", "/q"]), 5, None, None, None, "none") for k in range(80)]
    rows.append((900, "no time", "a", "a", "/p", 1, None, None, None, "none"))
    writer = scan.open_store(spark, str(tmp_path / "store"))
    order, changed = [("b", x) for x in bash] + [("r", x) for x in rows] + [("r", rows[3]), ("b", bash[5])], 0
    rng.shuffle(order)
    cuts = [0, *sorted(rng.randrange(len(order)) for _ in range(2)), len(order)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        def write(df, name, n=n):
            df.write.parquet(str(tmp_path / f"{n}-{name}"))
            return spark.read.schema(df.schema).parquet(str(tmp_path / f"{n}-{name}"))

        part = order[a:b]
        change = writer.start()
        frame = lambda kind, schema: spark.createDataFrame([x for k, x in part if k == kind], schema)  # noqa: B023, E731
        done = attributing.keep(change, frame("r", ROWS), frame("b", BASH), 0, write, horizon_s=10**10, buckets=4)
        changed += done.changed
        change.commit()
    columns = ["rtk_row_id", "source", "session_id", "tool_event_id", "match_kind"]
    want = attribute(spark.createDataFrame(rows, ROWS), spark.createDataFrame(bash, BASH)).select(columns)
    got = writer.store.read("savings").select(columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert changed >= want.filter("match_kind <> 'none'").count() > 20


def test_rows_beyond_the_horizon_keep_what_they_have(spark, tmp_path):
    writer = scan.open_store(spark, str(tmp_path / "store"))
    row = [(1, stamp(100), "a", "a", "/p", 5, None, None, None, "none")]
    event = [(7, "c", "s", stamp(110), "/p", ["a"], ["a"])]
    now = 1772359200 + 100  # the row's time

    def run(rows, events, as_of, n):
        change = writer.start()
        write = lambda df, name: (df.write.parquet(str(tmp_path / f"{n}-{name}")), spark.read.schema(df.schema).parquet(str(tmp_path / f"{n}-{name}")))[1]
        done = attributing.keep(change, spark.createDataFrame(rows, ROWS), spark.createDataFrame(events, BASH), as_of, write, buckets=2)
        change.commit()
        return done

    assert run(row, [], now, 0) == attributing.Attributed(none=1)
    assert run([], event, now + 49 * 3600, 1) == attributing.Attributed()  # too late
    assert run([], [(8, *event[0][1:])], now + 3600, 2) == attributing.Attributed(text=1, changed=1)
    assert [r.tool_event_id for r in writer.store.read("savings").collect()] == [7]


MESSAGES = "id string, session_id string, time_created bigint, time_updated bigint, data string, version string, worktree string"


def message(k, updated, n, completed=None, role="assistant", **more):
    data = {"role": role, "modelID": "m", "tokens": {"input": n, "output": 1, "reasoning": 0, "cache": {"read": 2, "write": 3}}, "time": {"created": 1, **({"completed": completed} if completed else {})}, "path": {"cwd": "/w/", "root": "/r"}} | more
    return (f"m{k}", "s", 1_700_000_000_000 + k, updated, json.dumps(data), "1.0", "/tree")


def test_messages_wait_until_they_are_quiet_or_done(spark):
    rng = random.Random(4)
    now, waiting, floor, got, last = 10_000_000, None, 0, [], {}
    for _ in range(6):
        rows = []
        for k in range(12):
            if rng.random() < 0.6 and not last.get(k, (0, False))[1]:
                now += rng.randrange(1000)
                done = rng.random() < 0.3
                row = message(k, now, rng.randrange(1, 99), now if done else None)
                rows.append(row)
                last[k] = (row, done)
        now += rng.choice([1000, 400_000])
        frame = spark.createDataFrame(rows, MESSAGES)
        judged, left = gate.release(waiting, frame, now)
        got += judged.select("outcome", "message_id", "input_tokens", "time_updated").collect()
        waiting = spark.createDataFrame(left.collect(), MESSAGES)
        floor = gate.floor_of(waiting, frame, floor)
        held = [r.time_updated for r in waiting.collect()]
        assert all(floor <= t for t in held) and all(now - t <= databases.GRACE_MS for t in held)
    judged, left = gate.release(waiting, spark.createDataFrame([], MESSAGES), now + 700_000)
    got += judged.select("outcome", "message_id", "input_tokens", "time_updated").collect()
    assert left.count() == 0
    final = {r.message_id: (r.input_tokens, r.time_updated) for r in sorted(got, key=lambda r: r.time_updated)}
    assert final == {f"m{k}": (json.loads(row[4])["tokens"]["input"], row[3]) for k, (row, _) in last.items()}  # nothing is lost
    assert len({(r.message_id, r.time_updated) for r in got}) == len(got)  # or counted twice


def test_rules_of_messages(spark):
    now = 10_000_000
    odd = [
        message(0, 1, 5, completed=9), message(1, now - 5, 5), message(2, now - 600_001, 5), message(3, 1, 5, role="user"), ("m4", "s", 1, 1, "{", None, None),
        message(5, 1, 5, 9, tokens=7), message(6, 1, 0, 9, tokens={"input": 0, "output": 0}), message(7, 1, 5, 9, cost=0.5, path={}), message(8, 1, 5, 9, cost=0, modelID="", path={"root": "/r/x/"}),
        message(9, 1, 5, 9, tokens={"input": 2.5, "output": "7", "cache": {"read": 4}}),
    ]
    rows = {r.message_id: r for r in databases.opencode_events(spark.createDataFrame(odd, MESSAGES), now).collect()}
    assert [rows[f"m{k}"].outcome for k in range(10)] == ["event", "gated", "event", "ignore", "skip", "skip", "ignore", "event", "event", "event"]
    assert (rows["m0"].input_tokens, rows["m0"].output_tokens, rows["m0"].cache_read_tokens, rows["m0"].cache_creation_tokens, rows["m0"].project, rows["m0"].cost_usd) == (5, 1, 2, 3, "/w", None)
    assert (rows["m7"].cost_usd, rows["m7"].project, rows["m8"].cost_usd, rows["m8"].model, rows["m8"].project) == (0.5, "/tree", None, "unknown", "/r/x")
    assert (rows["m9"].input_tokens, rows["m9"].output_tokens, rows["m9"].cache_read_tokens) == (0, 0, 4)
    assert rows["m0"].ts == "2023-11-14T22:13:20.000Z" and rows["m0"].request_id == "" and rows["m0"].agent_version == "1.0"


def sessions_of(spark, rows):
    """A sessions table as the SQLite source gives it."""
    columns = list(dict.fromkeys(c for r in rows for c in r))
    value = lambda v: (
        {None: "null", int: "integer", float: "real", str: "text"}[type(v) if v is not None else None], v if isinstance(v, str) else None,
        v if isinstance(v, int) else None, float(v) if isinstance(v, (int, float)) else None,
    )
    data = [tuple(dict(zip(("kind", "text", "whole", "real"), value(r.get(c)), strict=True)) for c in columns) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {sqlite.VALUE}" for c in columns))


def test_rules_of_cumulative_sessions(spark):
    base = {"id": "a", "model": "m", "started_at": 1_700_000_000.5, "input_tokens": 10, "output_tokens": -3, "cache_read_tokens": 2.9, "cache_write_tokens": "7", "cwd": "/w/app/"}
    rows = [
        base, base | {"id": "b", "started_at": 1_700_000_000_123}, base | {"id": "c", "started_at": "2026-03-01T10:00:00"}, base | {"id": "d", "started_at": "2026-03-01T10:00:00+02:00", "ended_at": 1_700_000_000},
        base | {"id": "e", "started_at": None}, base | {"id": "", "model": ""}, base | {"id": "g", "input_tokens": 0, "cache_read_tokens": None},
        base | {"id": "h", "actual_cost_usd": 0.4, "estimated_cost_usd": 9.0}, base | {"id": "i", "cost_status": "estimated", "billing_mode": "official_models_api", "estimated_cost_usd": 0.2},
        base | {"id": "j", "cost_status": "estimated", "billing_mode": "subscription_included", "estimated_cost_usd": 0.2}, base | {"id": "k", "cost_status": "estimated", "billing_mode": "other", "estimated_cost_usd": 0.3},
        base | {"id": "l", "cost_status": "other", "estimated_cost_usd": 0.3}, base | {"id": "m", "cwd": "", "git_repo_root": "/repo", "model": ""},
    ]
    got = {r.message_id: r for r in databases.hermes_events(sessions_of(spark, rows)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {k: "event" for k in "abcdhijklm"} | {"e": "skip", "": "skip", "g": "ignore"}
    assert (got["a"].input_tokens, got["a"].output_tokens, got["a"].cache_read_tokens, got["a"].cache_creation_tokens) == (10, 0, 2, 0)
    assert [got[k].ts[:19] for k in "abcd"] == ["2023-11-14T22:13:20", "2023-11-14T22:13:20", "2026-03-01T10:00:00", "2023-11-14T22:13:20"]
    assert {k: (got[k].cost_usd, got[k].cost_basis) for k in "ahijkl"} == {
        "a": (None, "estimated"), "h": (0.4, "logged"), "i": (0.2, "logged"), "j": (None, "estimated"), "k": (0.3, "estimated"), "l": (None, "estimated"),
    }
    assert (got["m"].project, got["m"].model, got["a"].project) == ("/repo", "unknown", "/w/app")
    old = databases.hermes_events(sessions_of(spark, [{"id": "x", "started_at": 5}]))  # a table from before there were counters
    assert [r.outcome for r in old.collect()] == ["ignore"]
    with pytest.raises(ValueError, match="id"):
        databases.hermes_events(sessions_of(spark, [{"model": "m"}]))


def test_distinct_counts_of_any_days(spark):
    rng = random.Random(2)
    rows = [(f"2026-03-{rng.randrange(1, 9):02d}T00:00:00Z", rng.choice(["a", "b"]), rng.choice([None, *(f"s{k}" for k in range(40))]), f"p{rng.randrange(5)}", f"m{rng.randrange(3)}") for _ in range(400)]
    schema = "ts string, source string, session_id string, project_label string, machine_id string"
    numbers = known = None
    for k in range(3):
        batch = spark.createDataFrame(rows[k * 100 : 100 + k * 150], schema)  # they overlap
        numbers = spark.createDataFrame((d := distinct.dictionary(numbers, batch)).collect(), d.schema)
        known = spark.createDataFrame((b := distinct.either(known, distinct.bitmaps(batch, numbers))).collect(), b.schema)
    by_kind = {}
    for r in numbers.collect():
        by_kind.setdefault(r.kind, []).append(r.number)
    assert all(sorted(x) == list(range(len(x))) for x in by_kind.values())
    for first, last, source in (("2026-03-01", "2026-03-09", None), ("2026-03-03", "2026-03-04", "a"), ("2026-04-01", "2026-04-02", None)):
        chosen = [r for r in rows if first <= r[0][:10] <= last and source in (None, r[1])]
        picked = known.filter(F.col("day").between(first, last) & (F.lit(True) if source is None else F.col("source") == source))
        want = tuple(len({r[k] for r in chosen} - {None}) for k in (2, 3, 4))
        assert tuple(distinct.counts(picked).first()) == want


def test_windows_equal_those_over_all_events_at_each_trigger(spark):
    rng = random.Random(8)
    schema = "id bigint, ts string, source string, cost_basis string, project_label string, machine_id string, " + ", ".join(f"{c} bigint" for c in TOKENS)
    hour = lambda h: f"2026-03-{1 + h // 24:02d}T{h % 24:02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}.123Z"
    row = lambda k, h: (k, hour(h), rng.choice(["claude_code", "codex"]), rng.choice(["estimated", "estimated", "logged"]), "p", "m", *(rng.randrange(50) for _ in TOKENS))
    frame = lambda rows: spark.createDataFrame(rows, schema)
    now, kept = {}, None
    for h in (30, 100, 240):
        batch = [row(k, max(0, h - rng.randrange(60))) for k in range(h, h + 25)]  # late ones too
        batch += [row(k, max(0, h - rng.randrange(200))) for k in rng.sample(sorted(now), min(8, len(now)))]  # replaced
        was = [now[r[0]] for r in batch if r[0] in now]
        now |= {r[0]: r for r in batch}
        grown = windows.add(kept, windows.delta(frame(was) if was else None, frame(batch)))
        kept = spark.createDataFrame(grown.collect(), grown.schema)
        for as_of in (hour(h)[:19] + "Z", hour(h + 3)[:19] + "Z"):
            for override in (None, "subscription"):
                got = api.plan_windows(windows.as_events(kept), api.Filter(), as_of, limits=(1000, 5000), override=override)
                want = api.plan_windows(frame(list(now.values())), api.Filter(), as_of, limits=(1000, 5000), override=override)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
