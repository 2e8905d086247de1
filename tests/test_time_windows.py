"""Attribution and rolling sums against brute force over random rows with ties, nulls and full buckets."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.operators import attribution
from meterlake.operators.api import rolling_usage
from meterlake.operators.attribution import attribute
from meterlake.plans.schema import TOKENS


def _ts(e: int | None) -> str | None:
    return None if e is None else datetime.fromtimestamp(e, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _expected(row: tuple, events: list[tuple]) -> tuple:
    _, e, cmd, head, project = row
    near = [] if e is None else [x for x in events if x[1] is not None and abs(x[1] - e) <= 120]
    pick = lambda xs: min(xs, key=lambda x: (abs(x[1] - e), x[0]))
    text = [x for x in near if cmd in x[6]]
    if text:
        x, kind = pick(text), "text"
        return x[2], x[3], x[0], kind
    heads = [x for x in near if head in x[5]]
    for xs, holds in ((heads, True), (near, bool(near) and min(near, key=lambda x: (x[1], x[0]))[4] == project)):
        if xs and holds and len({x[2:4] for x in xs}) == 1:
            x = pick(xs)
            return x[2], x[3], x[0], "window"
    return None, None, None, "none"


@pytest.mark.parametrize("seed, sessions, span", [(0, 1, 900), (1, 2, 4000), (2, 5, 1500), (3, 1, 20000)])
def test_attribution_equals_brute_force(spark, seed, sessions, span):
    r = random.Random(seed)
    when = lambda: r.choice([None] + [1_700_000_000 + r.randrange(span) for _ in range(12)])
    events = [
        (n, when(), "codex", f"s{r.randrange(sessions)}", r.choice(["/p", "/q"]), r.sample(["a", "b", "c"], r.randrange(3)), r.sample(["A", "B", "C", "D"], r.randrange(3)))
        for n in range(40)
    ]
    rows = [(n, when(), r.choice(["A", "B", "E", None]), r.choice(["a", "b", "z", None]), r.choice(["/p", "/q", None])) for n in range(80)]
    schema = "id long, ts string, source string, session_id string, project string, head_hashes array<string>, chain_hashes array<string>"
    bash = spark.createDataFrame([(x[0], _ts(x[1]), *x[2:]) for x in events], schema)
    blank = (None, None, None, "none", "kept")
    savings = spark.createDataFrame(
        [(x[0], _ts(x[1]), *x[2:], *blank) for x in rows],
        "rtk_row_id long, ts string, cmd_hash string, head_hash string, project_path string, source string, session_id string, tool_event_id long, match_kind string, extra string",
    )
    got = attribute(savings, bash).collect()
    assert {x.extra for x in got} == {"kept"}
    assert {x.rtk_row_id: (x.source, x.session_id, x.tool_event_id, x.match_kind) for x in got} == {x[0]: _expected(x, events) for x in rows}
    assert len(got) == len(rows)


@pytest.mark.parametrize("span", [1, 7, 60, 3600])
def test_rolling_usage_equals_brute_force(spark, span):
    r = random.Random(span)
    rows = [(n, r.choice(["x", "y", None]), r.choice([None, *range(-5, 400, 3)]), r.randrange(100)) for n in range(300)]
    rows += [(1000 + n, "x", span * n, 1) for n in range(6)]  # at the buckets' ends
    schema = "id long, source string, ts string, " + ", ".join(f"{c} long" for c in TOKENS)
    df = spark.createDataFrame([(n, s, _ts(e), *(k if c == TOKENS[0] else 0 for c in TOKENS)) for n, s, e, k in rows], schema)
    want = {n: sum(k for _, s2, e2, k in rows if s2 == s and e2 is not None and e - span <= e2 <= e) for n, s, e, _ in rows if e is not None}
    got = rolling_usage(df, span).collect()
    assert {x.id: x.rolling_tokens for x in got} == want
    assert len(got) == len(want)


def test_looking_around_pairs_no_row_with_an_event(spark):
    rng = random.Random(21)
    ask = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(9000) if rng.random() < 0.95 else None) for _ in range(400)]
    have = {(rng.choice(["a", "b", None]), rng.randrange(9000)): rng.randrange(50) for _ in range(300)} | {("a", 3600): 1, ("a", 3720): 0, ("b", 7200): 4}
    ask += [("a", 3660), ("a", 3600), ("a", 3599), ("b", 7080), ("b", 7079), ("b", 7320), ("b", 7321)]
    rows = spark.createDataFrame(ask, "k string, _e bigint")
    who = F.struct(F.col("w").alias("id"))
    seconds = spark.createDataFrame([(*p, w) for p, w in have.items()], "k string, t_e bigint, w bigint").select(
        "k", "t_e", who.alias("who"), who.alias("least"), who.alias("most"), F.col("w").cast("string").alias("project"))
    found = attribution._around(rows, seconds, ["k"], 120)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r._e): (r.near.id, r.least.id, r.most.id, r.first) for r in found.collect()}
    want = {}
    for k, e in set(ask):
        near = [(abs(t - e), w, t) for (j, t), w in have.items() if None not in (k, e) and j == k and abs(t - e) <= 120]
        if near:
            want[k, e] = (min(near)[1], min(w for _, w, _ in near), max(w for _, w, _ in near), str(min((t, w) for _, w, t in near)[1]))
    assert got == want and len(want) > 100
