"""Rollout state carried over pieces of a file and over scans equals the state that runs down the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.sources import carried, rollouts

RECORD = (
    "file string, line_no bigint, kind string, meta_session string, cwd string, version string, replay_suspect boolean, model string, outcome string, ts string, "
    "input bigint, cached bigint, output bigint, reasoning bigint, cumulative bigint, piece bigint, scan int"
)


def log(rng, name, n, pieces, scans):
    """A file of n lines cut into pieces and scans; seconds never go back."""
    rows, second, total = [], 0, 0
    cuts = sorted(rng.randrange(n + 1) for _ in range(scans - 1))
    for k in range(n):
        scan = sum(k >= c for c in cuts)
        piece = rng.randrange(2) if not rows or rows[-1][-1] != scan else rows[-1][-2] + (rng.random() < pieces / n)
        second += rng.choice([0, 0, 1, 2])
        kind = rng.choices(["session_meta", "turn_context", "token_count", "broken"], [1, 2, 8, 1])[0]
        meta = kind == "session_meta"
        total += 5
        rows.append((
            name, k * 10, kind, rng.choice([f"s{k}", None]) if meta else None, rng.choice([f"/w/{k}", None]) if kind in ("session_meta", "turn_context") else None,
            rng.choice(["", f"v{k}"]) if meta else None, meta and rng.random() < 0.6, rng.choice([f"m{k}", None]) if kind == "turn_context" else None,
            {"token_count": rng.choice(["ok", "ok", "ok", "skip"]), "broken": "skip"}.get(kind), f"2026-03-01T10:{second // 60:02d}:{second % 60:02d}.000Z",
            rng.randrange(50), rng.randrange(20), 3, 1, total, int(piece), scan,
        ))
    return rows


@pytest.mark.parametrize("scans", [1, 4])
def test_any_cut_gives_the_events_of_the_whole_file(spark, scans):
    rng = random.Random(scans)
    rows = [r for f in range(40) for r in log(rng, f"f{f}", rng.randrange(1, 60), rng.choice([1, 3, 20]), scans)]
    records = spark.createDataFrame(rows, RECORD).cache()
    want = sorted(map(tuple, rollouts.usage_events(records.drop("piece", "scan")).collect()), key=repr)
    got, state = [], None
    for k in range(scans):
        events, state = carried.usage_events(records.filter(F.col("scan") == k).drop("scan"), state)
        got += map(tuple, events.collect())
        state = spark.createDataFrame(state.collect(), carried.STATE)
    assert len(want) > 100 and sorted(got, key=repr) == want


def test_a_held_event_waits_for_the_next_line(spark):
    base = lambda line, kind, **x: {"file": "f", "line_no": line, "kind": kind, "piece": 0, "replay_suspect": False, **x}
    count = lambda line, second: base(line, "token_count", outcome="ok", ts=f"2026-03-01T10:00:0{second}.000Z", input=9, cached=4, output=1, reasoning=0, cumulative=line)
    frame = lambda rows: spark.createDataFrame(rows, RECORD.rsplit(",", 1)[0])
    first = [base(0, "session_meta", meta_session="s", replay_suspect=True), count(1, 1)]
    events, state = carried.usage_events(frame(first))
    assert events.count() == 0 and [(r.segment, r.flagged, r.held.line_no) for r in state.collect()] == [(1, True, 1)]
    state = spark.createDataFrame(state.collect(), carried.STATE)
    events, _ = carried.usage_events(frame([count(2, 2)]), state)
    assert [r.line_no for r in events.collect()] == [1]  # another second lets it go
    events, after = carried.usage_events(frame([count(2, 1), count(3, 5)]), state)
    assert [r.line_no for r in events.collect()] == [3]  # the same second is the replay's
    assert [(r.replay[-2:], r.held) for r in after.collect()] == [("01", None)]
    events, after = carried.usage_events(frame([]), state)
    assert events.count() == 0 and after.collect()[0].held.line_no == 1
