"""Scans, commits of several tables, byte ranges of files, and pairing as a stream, over logs the tests write."""

import json
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from meterlake.operators import cube
from meterlake.operators.dedup import keep_highest
from meterlake.operators.tools import CALL
from meterlake.sources import rollouts, slices, transcripts
from meterlake.streaming import pairing, scan, store

from .test_sources import block, count, meta, turn, write

AS_OF = "2026-03-02T00:00:00Z"


def rows_of(table, *drop):
    return Counter(map(repr, table.drop(*drop).collect()))


def keep_new(old, new):
    return new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)


def put(spark, writer, rows, **state):
    change = writer.start()
    change.upsert("t", spark.createDataFrame(rows, "k bigint, v string"), ("k",), keep_new, buckets=16)
    change.state |= state
    return change


def files_of(folder):
    return {p for p in Path(folder, "tables").rglob("*.parquet")}


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    writer = scan.open_store(spark, str(tmp_path))
    put(spark, writer, [(k, "old") for k in range(500)]).commit()
    before = files_of(tmp_path)
    base = writer.store.head()
    change = put(spark, writer, [(7, "new"), (1000, "new")])
    change.commit()
    written = files_of(tmp_path) - before
    assert len(before) == 16 and 1 <= len(written) <= 2
    assert {r.k: r.v for r in writer.store.read("t").collect()} == {k: "old" for k in range(500)} | {7: "new", 1000: "new"}
    assert {r.v for r in writer.store.read("t", at=base).collect()} == {"old"}  # a reader of the commit before isn't disturbed
    moved = [b for b, p in writer.store.head().tables["t"]["parts"].items() if base.tables["t"]["parts"].get(b) != p]
    assert len(moved) == len(written)
    assert writer.store.vacuum(keep=1) == len(moved)
    assert writer.store.read("t").count() == 501 and len(files_of(tmp_path)) == 16
    change = writer.start()
    assert change.upsert("t", spark.createDataFrame([], "k bigint, v string"), ("k",), keep_new) == []


def test_of_two_changes_of_a_commit_one_wins(spark, tmp_path):
    writer = scan.open_store(spark, str(tmp_path))
    one, two = put(spark, writer, [(1, "one")], cursor=1), put(spark, writer, [(1, "two")], cursor=2)
    two.commit()
    with pytest.raises(store.Conflict):
        one.commit()
    assert [r.v for r in writer.store.read("t").collect()] == ["two"] and writer.store.head().state == {"cursor": 2}


def test_a_writer_that_was_taken_over_is_fenced_off(spark, tmp_path):
    old = scan.open_store(spark, str(tmp_path))
    change = put(spark, old, [(1, "old")])
    new = scan.open_store(spark, str(tmp_path))
    put(spark, new, [(1, "new")]).commit()
    with pytest.raises(store.Fenced):
        change.commit()
    with pytest.raises(store.Fenced):
        old.start()
    assert [r.v for r in new.store.read("t").collect()] == ["new"]


def test_what_is_killed_before_its_commit_leaves_the_old_tables(spark, tmp_path):
    writer = scan.open_store(spark, str(tmp_path))
    put(spark, writer, [(1, "a")], cursor=1).commit()
    put(spark, writer, [(1, "b"), (2, "b")], cursor=2)  # and no commit
    again = store.Store(spark, str(tmp_path))
    assert [r.v for r in again.read("t").collect()] == ["a"] and again.head().state == {"cursor": 1}


def test_a_commit_file_is_created_once(spark, tmp_path):
    """By processes that race: one of each commit's creators wins."""
    (tmp_path / "commits").mkdir()
    code = "import os,sys\nfor k in range(200):\n  t=f'{sys.argv[1]}/_{os.getpid()}'\n  open(t,'w').write(str(os.getpid()))\n  try: os.link(t,f'{sys.argv[1]}/{k}'); print(k)\n  except FileExistsError: pass\n  os.remove(t)"
    runs = [subprocess.Popen([sys.executable, "-c", code, str(tmp_path / "commits")], stdout=subprocess.PIPE, text=True) for _ in range(3)]
    won = [int(x) for r in runs for x in r.communicate()[0].split()]
    assert sorted(won) == list(range(200))
    s = store.Store(spark, str(tmp_path / "s"))
    assert s._create("commits/000000000001.json", "{}") and not s._create("commits/000000000001.json", "[]")
    assert s._read_text("commits/000000000001.json") == "{}"


def random_file(rng, path, n):
    lines = ["" if rng.random() < 0.1 else "é" * rng.randrange(30) + str(k) for k in range(n)]
    path.write_text("".join(x + "\n" for x in lines) + rng.choice(["", "open end"]), encoding="utf-8")
    return lines


@pytest.mark.parametrize("span", [1, 7, 64, 1 << 20])
def test_ranges_of_a_file_have_each_line_once(spark, tmp_path, span):
    rng = random.Random(span)
    want = {f"{k}.jsonl": random_file(rng, tmp_path / f"{k}.jsonl", n) for k, n in enumerate((0, 1, 2, 40))}
    packed = [f"line {k}" for k in range(500)]
    frames = ["\n".join(packed[:200]) + "\n", "\n".join(packed[200:]) + "\nrest"]
    (tmp_path / "z.jsonl.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(x.encode()) for x in frames))
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\xfe\nok\r\n")
    planned = slices.plan(slices.listing(spark, [str(tmp_path), str(tmp_path)]), None)
    lines = slices.read_ranges(slices.ranges(planned, span), tasks=3).cache()
    got = {}
    for r in lines.orderBy("path", "line_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    for name, texts in want.items():
        assert [r.text for r in got.get(name, [])] == texts
    assert [r.text for r in got["z.jsonl.zst"]] == packed and [r.text for r in got["bad.jsonl"]] == [None, "ok"]
    for rows in got.values():
        assert [r.piece for r in rows] == sorted(r.piece for r in rows)
        assert [r.next_offset for r in rows[:-1]] == [r.line_no for r in rows[1:]] or rows[0].path.endswith(".zst")
    assert span > 7 or lines.filter("path LIKE '%3.jsonl'").select("piece").distinct().count() > 10
    ends = {r.path.rsplit("/", 1)[1]: r.offset for r in slices.cursors_after(planned, lines).collect()}
    assert ends["3.jsonl"] == sum(len(x.encode()) + 1 for x in want["3.jsonl"]) and ends["0.jsonl"] == 0


def test_where_a_scan_reads_on(spark):
    cases = [(None, None, None, 9, 1, 0), (9, 1, 9, 9, 1, None), (9, 1, 5, 12, 2, 5), (9, 1, 5, 7, 2, 0), (9, 2, 9, 9, 3, 0), (9, 2, 9, 12, 1, 0)]
    rows = [(ks, km, off, s, m, "a.jsonl") for ks, km, off, s, m, _ in cases]
    df = spark.createDataFrame(rows, "known_size long, known_mtime long, offset long, size long, mtime long, path string")
    assert [r[0] for r in df.select(slices.resume_at()).collect()] == [c[-1] for c in cases]


def talk(rng, session, n):
    """A transcript: usage that is repeated and grows, calls whose results come later or never."""
    out, open_ = [], []
    for k in range(n):
        ts = f"2026-03-01T10:{k // 60:02d}:{k % 60:02d}.000Z"
        what = rng.random()
        if what < 0.4:
            m = rng.randrange(n // 3 + 1)
            out.append(turn(f"{session}-m{m}", "r", rng.randrange(200), ts=ts, sessionId=session))
        elif what < 0.7 or not open_:
            i = f"{session}-t{rng.randrange(n // 2 + 1)}"
            open_.append(i)
            out.append(block("tool_use", ts=ts, id=i, name=rng.choice(["Bash", "Read"]), input={"command": f"ls {k}"}) | {"sessionId": session})
        else:
            out.append(block("tool_result", ts=ts, tool_use_id=rng.choice(open_), content="x" * k) | {"sessionId": session})
    return out


def rolled(rng, name, n):
    out, second = [meta(name, **({"forked_from_id": "p"} if rng.random() < 0.5 else {}))], 0
    for k in range(n):
        second += rng.randrange(3)
        out.append(rng.choice([count(second % 60, k), count(second % 60, k), {"timestamp": "x", "type": "turn_context", "payload": {"model": f"g-{k}", "cwd": f"/w/{k}"}}]) if second < 60 else count(59, k))
    return out


def ledger_of(spark, texts, rolls):
    """What one pass over all lines gives."""
    from meterlake.functions.costs import price

    lines = lambda files: spark.createDataFrame([(p, k, json.dumps(r)) for p, rs in files.items() for k, r in enumerate(rs)], "path string, line_no bigint, text string")
    one, two = lines(texts), lines(rolls)
    usage = transcripts.usage_events(one).filter("outcome = 'event'").drop("outcome").unionByName(rollouts.usage_events(rollouts.parse_lines(two)).withColumnRenamed("file", "path"))
    usage = keep_highest(price(scan.numbered(usage, 0)).drop("path", "line_no"))
    calls = pairing.merge_calls(None, pairing.seen(transcripts.tool_uses(one), transcripts.tool_results(one), F.struct("path", "line_no", "block_no")))
    return usage, calls


@pytest.mark.parametrize("seed", [1])
def test_scans_of_a_growing_log_equal_one_pass(spark, tmp_path, seed):
    rng = random.Random(seed)
    logs, rolls = tmp_path / "logs", tmp_path / "rolls"
    logs.mkdir(), rolls.mkdir()
    texts = {f"s{k}.jsonl": talk(rng, f"s{k}", rng.randrange(5, 60)) for k in range(5)}
    codex = {f"r{k}.jsonl": rolled(rng, f"r{k}", rng.randrange(5, 50)) for k in range(5)}
    writer = scan.open_store(spark, str(tmp_path / "store"))
    run = lambda: scan.scan(spark, writer, transcript_roots=[str(logs)], rollout_roots=[str(rolls)], as_of=AS_OF, range_bytes=700, buckets=8)
    sums = []
    for part in (0.3, 0.6, 1.0):
        for folder, files in ((logs, texts), (rolls, codex)):
            for name, records in files.items():
                n = int(len(records) * part)
                half = json.dumps(records[n])[:20] if n < len(records) else ""  # a line being written
                write(folder / name, records[:n], tail=half)
                os.utime(folder / name, ns=(1, int(part * 1e15)))
        sums.append(run())
    usage, calls = ledger_of(spark, texts, codex)
    names = ("id", "ingest_seq", "dirty", "project_label", "machine_id", "machine_name")
    got = writer.store.read("usage")
    assert rows_of(got.select(sorted(set(got.columns) - set(names)))) == rows_of(usage.select(sorted(set(usage.columns) - set(names))))
    assert got.select("id").distinct().count() == got.count()
    done = lambda t: rows_of(pairing.tool_events(t).select("source", "session_id", "tool_use_id", "ts", "est_args_tokens", "est_result_tokens", "chain_hashes"))
    assert done(writer.store.read("calls")) == done(calls)
    assert {r.tool_use_id for r in pairing.open_uses(writer.store.read("calls")).collect()} == {r.tool_use_id for r in pairing.open_uses(calls).collect()}
    assert sum(s.events_inserted for s in sums) == got.count() and sum(s.tool_events_inserted for s in sums) == sum(done(calls).values())
    kept = writer.store.read("cells").select(*cube.CELL, *cube.SUMS)
    assert rows_of(kept) == rows_of(cube.add(None, cube.cells(got)).select(kept.columns))  # sums took in every change
    head = writer.store.head()
    assert run() == scan.Summary() and writer.store.head().number == head.number  # a second scan adds nothing

    one = logs / "s0.jsonl"
    write(one, [*texts["s0.jsonl"], turn("new", "r", 5, ts="2026-03-01T11:00:00.000Z", sessionId="s0")])
    before = files_of(tmp_path / "store")
    more = run()
    assert (more.files_scanned, more.events_inserted, more.duplicates_dropped, more.tool_events_inserted) == (1, 1, 0, 0)  # only itself
    assert len({p for p in files_of(tmp_path / "store") - before if "/usage/" in str(p)}) == 1
    write(one, list(reversed(texts["s0.jsonl"])))  # rewritten
    assert run().events_inserted == 0 and not list((tmp_path / "store").glob("scratch*"))


def test_a_scan_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs / "a.jsonl", [turn("m1", "r", 5)])
    writer = scan.open_store(spark, str(tmp_path / "store"))
    run = lambda: scan.scan(spark, writer, transcript_roots=[str(logs)], as_of=AS_OF, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(scan.slices, "cursors_after", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            run()
    assert writer.store.head().tables == {} and writer.store.read("usage") is None
    assert run().events_inserted == 1


def test_uses_that_wait_too_long_are_given_up(spark):
    uses = spark.createDataFrame([("c", "s", "old", "2026-01-01T00:00:00Z", "Read", 1, 1), ("c", "s", "new", "2026-02-20T00:00:00Z", "Read", 1, 2)], "source string, session_id string, tool_use_id string, ts string, tool_name string, est_args_tokens bigint, seq bigint")
    none = spark.createDataFrame([], "source string, session_id string, tool_use_id string, ts string, est_result_tokens bigint, is_error boolean, seq bigint")
    calls = pairing.merge_calls(None, pairing.seen(uses, none, F.col("seq")))
    assert [r.tool_use_id for r in pairing.give_up(calls, AS_OF).collect()] == ["new"]
    assert [r.tool_use_id for r in pairing.open_uses(calls, AS_OF).collect()] == ["new"]


SEEN = (
    "source string, session_id string, tool_use_id string, seq bigint, "
    "use struct<ts:string,project:string,tool_name:string,est_args_tokens:bigint,head_hashes:array<string>,chain_hashes:array<string>>, "
    "result struct<ts:string,est_result_tokens:bigint,is_error:boolean>"
)


def some_calls(rng, n, day="2026-03-01"):
    rows = []
    for k in range(n):
        key, ts = ("c", f"s{rng.randrange(3)}", f"t{rng.randrange(8)}"), f"{day}T10:00:{k:02d}Z"
        if rng.random() < 0.5:
            rows.append((*key, k, Row(ts=ts, project="/p", tool_name="Bash", est_args_tokens=k, head_hashes=["h"], chain_hashes=None), None))
        else:
            rows.append((*key, k, None, Row(ts=ts, est_result_tokens=k, is_error=False)))
    return rows


def brute_pairs(rows):
    use, done = {}, {}
    for *key, _, u, r in rows:
        key = tuple(key)
        if u is not None:
            use[key] = u
        elif key in use and key not in done:
            done[key] = (use[key].est_args_tokens, r.est_result_tokens, r.ts)
    return done


def paired(events):
    got = [((r.source, r.session_id, r.tool_use_id), (r.est_args_tokens, r.est_result_tokens, r.ts)) for r in events.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("cuts", [1, 2, 6])
def test_calls_pair_over_any_cut(spark, cuts):
    rng = random.Random(cuts)
    rows = some_calls(rng, 60)
    at = [0, *sorted(rng.randrange(61) for _ in range(cuts - 1)), 60]
    calls = None
    for a, b in zip(at, at[1:]):
        merged = pairing.merge_calls(calls, spark.createDataFrame(rows[a:b], SEEN))
        calls = spark.createDataFrame(merged.collect(), merged.schema)
    assert paired(pairing.tool_events(calls)) == brute_pairs(rows)


@pytest.fixture()
def rocks(spark):
    for k, v in pairing.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k in pairing.SETTINGS:
        spark.conf.unset(k)


def run_stream(spark, folder, out, days):
    lines = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = pairing.pair_stream(lines, days).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-marks")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pairing.EVENT).parquet(str(out))


def test_the_stream_pairs_over_batches_and_restarts(spark, rocks, tmp_path):
    rng = random.Random(9)
    rows = some_calls(rng, 60)
    for k, (a, b) in enumerate(((0, 11), (11, 12), (12, 40), (40, 60))):
        spark.createDataFrame(rows[a:b], SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = run_stream(spark, tmp_path / "in", tmp_path / "out", None)  # started anew for each batch
        assert paired(events) == brute_pairs(rows[:b]), k


def test_the_stream_forgets_old_calls(spark, rocks, tmp_path):
    use = [("c", "s", "t", 1, Row(ts="2020-01-01T00:00:00Z", project="/p", tool_name="Bash", est_args_tokens=1, head_hashes=None, chain_hashes=None), None)]
    result = [("c", "s", "t", 2, None, Row(ts="2020-01-01T00:00:09Z", est_result_tokens=3, is_error=False))]
    for rows, days, want in ((use, 30, 0), (result, 30, 0)):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run_stream(spark, tmp_path / "in", tmp_path / "out", days).count() == want
    spark.createDataFrame(use + result, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_stream(spark, tmp_path / "in", tmp_path / "out", 30).count() == 1  # within one batch even old ones pair
    assert CALL == ("source", "session_id", "tool_use_id")
