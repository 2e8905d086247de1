"""The thin queries against plain versions on the small tables, and the pipeline stage by stage."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import queries

from .conftest import SCHEMA, make_text
from .test_audit_mining_quality import brute_base

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in queries.documents(spark, SF_DIR).select("doc_id", "text").collect()}


def crc(x):
    return zlib.crc32(str(x).encode())


def plain(v):
    return v.item() if hasattr(v, "item") else v


@needs_tables
@pytest.mark.parametrize("name", ["op6_lm_score", "op11_divergence", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF_DIR).select(names).collect()
    tidy = lambda rows: Counter(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(got) == tidy(found.fetchall())


@needs_tables
def test_folds_and_predictions(spark, texts):
    one = queries.op1_language(spark, SF_DIR).collect()
    assert {r.doc_id: r.held_out for r in one} == {d: crc(d) % 4 == 2 for d in texts} and len(one) == len(texts)
    langs = {r.doc_id: r.lang for r in queries.documents(spark, SF_DIR).collect()}
    judged = [(r.lang_pred, langs[r.doc_id]) for r in one if r.held_out and langs[r.doc_id] and re.search(r"[^\W\d_]", texts[r.doc_id])]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged) and all(0 <= r.score <= 1 for r in one)
    seven = queries.op7_toxicity(spark, SF_DIR).collect()
    assert {r.doc_id: r.held_out for r in seven} == {d: crc(d) % 5 == 0 for d in texts}
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in seven)


@needs_tables
def test_quality_wrapper(spark, texts):
    rows = queries.op13_quality(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


@needs_tables
def test_shards_by_bytes(spark, texts):
    rows = queries.op5_sharding(spark, SF_DIR).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 3 * max(r.size for r in rows) and {r.law for r in rows} == {"bytes"}


@needs_tables
def test_secrets_and_media_wrappers(spark, texts):
    kinds = {
        "assign": lambda t: [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[1]) >= 6],
        "access": lambda t: [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20], "hex": lambda t: [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24],
    }
    for r in queries.op8_secrets(spark, SF_DIR).collect():
        found = {k: f(texts[r.doc_id]) for k, f in kinds.items()}
        joined = ",".join(f"{list(kinds)[k]}:{a}:{b}" for a, k, b in sorted((a, list(kinds).index(k), b) for k, xs in found.items() for a, b in xs))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found.values())) and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    for r in queries.op9_media(spark, SF_DIR).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


@needs_tables
def test_packing_wrapper(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows, own, at = queries.op3_packing(spark, SF_DIR).collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want = [(k, s, min(2048, len(ids) - s), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + 2048]))) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[d]) == want
    for pieces in at.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= 2048


def shingles(text):
    ws = text.encode().lower().split()
    return frozenset(b" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


@pytest.fixture(scope="module")
def corpus():
    """Documents whose fate in each stage is known."""
    rng = random.Random(31)
    line = lambda lang="en", n=12: make_text(lang, n, rng) + f" {rng.randrange(10**9)}"
    shared, item = line(n=30), line(n=40)
    docs = [(k, "\n".join(line("de" if k % 3 == 0 else "en") for _ in range(6)), "de" if k % 3 == 0 else "en", "s", 1) for k in range(40)]
    docs += [(100, None, "en", "s", 1), (101, "", None, None, None), (102, "12 34 !!", "en", "s", 1)]  # no language
    docs += [(110, f"{docs[1][1]}\n{shared}", "en", "s", 1), (111, f"{line()}\n{shared}\n{line()}", "en", "s", 1), (112, shared, "en", "s", 1)]  # shared lines
    words = line(n=200).split()
    wrapped = lambda ws, n: "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))
    docs += [(120, wrapped(words, 20), "en", "s", 1), (121, wrapped([*words[:90], "other", *words[91:]], 13), "en", "s", 1)]  # near copies in other lines
    docs += [(130, f"{line()} {item} {line()}", "en", "s", 1)]  # a leak
    return docs, [("i0", item), ("i1", line(n=33))]


def test_the_pipeline_does_what_its_stages_say(spark, corpus, tmp_path):
    docs, items = corpus
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({"_row": F.lit("x"), "_language": F.lit("y")})
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        kept[name] = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()} if k < 4 else now.collect()
    every = {d: t for d, t, *_ in docs}
    assert kept["language"] == {d: t for d, t in every.items() if re.search(r"[^\W\d_]", t or "")}

    seen, want = [], {}
    for d, text in sorted(kept["language"].items()):
        lines = []
        for x in text.split("\n"):
            s = frozenset(x.lower().split())
            if not s or not any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                lines.append(x)
            seen += [s] if s else []
        if any(x.strip() for x in lines):
            want[d] = "\n".join(lines)
    assert kept["line_dedup"] == want and 112 not in want and want[110] == shared_line(docs)

    left, sets = set(), {d: shingles(t) for d, t in want.items()}
    for d in sorted(want):  # no chains in these documents
        if not any(len(sets[d] & sets[o]) >= 0.8 * len(sets[d] | sets[o]) for o in left):
            left.add(d)
    assert set(kept["near_duplicates"]) == left and 121 in want and 121 not in left
    assert set(kept["decontamination"]) == {d for d in left if items[0][1] not in want[d]}
    assert 130 not in kept["decontamination"] and {r.doc_id for r in kept["packing"]} == set(kept["decontamination"])
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length")
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.piece, r.length) for r in kept["packing"])


def shared_line(docs):
    return next(t for d, t, *_ in docs if d == 112)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, empty, name, tmp_path):
    spark.createDataFrame([("i", make_text("en", 30, random.Random(1))), (None, None), ("e", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    assert name == "packing" or out.columns == odd.columns
    assert 0 < len(rows) <= (10**6 if name == "packing" else odd.count())
    if name in ("near_duplicates", "line_dedup"):
        ids = [r.doc_id for r in rows]
        assert ids.count(104) == 1 and ids.count(0) == 1  # repeated rows: the first one stays
    assert stage(spark, empty, str(tmp_path)).count() == 0
