"""The source audit, hard negatives and quality rules against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import divergence, hardneg, quality

from .conftest import SCHEMA, make_text

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    in_docs, groups, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        in_docs.update({(lang, t) for t in terms})
        groups[lang, source].update(terms)
        whole[lang].update(terms)
    out = set()
    for lang in {x[0] for x in docs}:
        kept = [t for t in whole[lang] if in_docs[lang, t] >= min_docs]

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = share(whole[lang]), {s: share(groups[a, s]) for a, s in groups if a == lang}
        for s in p:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def some_documents(n=300):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        lang = ["en", "de", None][k % 3]
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(9)}"
        rows.append((k, make_text(lang or "en", rng.randrange(5, 60), rng) + rng.choice(["", " Straße", " ÉTÉ été", f" own{source}"] * (1 + k % 2)), lang, source, 1))
    return [*rows, (n, None, "fr", None, 1), (n + 1, "", "fr", "s1", None), (n + 2, "1234 !!", "fr", "s2", 0), rows[0], rows[0], (None, rows[1][1], "en", "s1", 1)]


@pytest.mark.parametrize("sizes", [(1024, 64), (7, 3), (1, 1)])
def test_divergence_equals_plain_sums(spark, sizes):
    rows = some_documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("x")).repartition(5)
    got = divergence.divergence(docs, min_docs=5, top=4, terms=sizes[0], sources=sizes[1]).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_divergence(rows, 5, 4)


def test_terms_that_no_source_of_a_tile_has_count_in_its_pairs(spark):
    own = {s: [f"{s}{chr(97 + k)}" for k in range(n)] for s, n in (("aa", 3), ("bb", 7), ("cc", 12), ("dd", 1))}
    rows = [(k, " ".join(own[s] * (1 + k % 3)), "en", s, 1) for k, s in enumerate(own)]
    for sources in (1, 2, 64):
        got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), min_docs=1, top=4, terms=2, sources=sources).collect()
        assert set(map(tuple, got)) == brute_divergence(rows, 1, 4)


def test_divergence_of_odd_rows(odd, odd_rows, empty):
    assert set(map(tuple, divergence.divergence(odd, min_docs=2).collect())) == brute_divergence(odd_rows, 2, 10)
    assert divergence.divergence(empty).count() == 0


def test_divergence_without_a_broadcast(spark):
    rows = some_documents(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert set(map(tuple, divergence.divergence(docs, min_docs=3, small=0).collect())) == brute_divergence(rows, 3, 10)


def test_sums_held_by_a_task_are_bounded(spark, monkeypatch):
    rows = some_documents(90)
    monkeypatch.setattr(divergence, "_HELD", 10)
    found = Counter()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows]), pa.array([r[1] or "" for r in rows])], names=["lang", "source", "text"])

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    parts = divergence.partial_counts(Frame())
    assert len(parts) > 50
    for part in parts:
        for r in part.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((lang or "", source or "", t) for _, text, lang, source, _ in rows for t in TERM.findall((text or "").translate(LOWER)))
    assert {k: n for k, n in found.items() if k[2] is not None} == want


def test_shares_and_differences_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total, terms = rng.randrange(1, 10 ** rng.randrange(1, 16)), rng.randrange(1, 10**6)
        count = rng.randrange(total + 1)
        assert int(divergence.shares(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)
        p, q = rng.randrange(1, 10**9 + 2), rng.randrange(1, 10**9 + 2)
        assert int(divergence.differ(np.array([p]), np.array([q]))[0]) == (p - q) ** 2 // (p + q)


VECTORS = "vec_id bigint, embedding array<float>, label int, score string, row string"


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (ai, av, al) in enumerate(kept):
        if not is_anchor(ai):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, k, label) for k, (i, v, label) in enumerate(kept) if k != a)
        for p, pi, _, _ in [s for s in scored if s[3] == al][:positives]:
            near = [s for s in scored if s[3] != al and 4 * -p <= 5 * -s[0] <= 5 * -p][:negatives]
            out.update((ai, pi, k + 1, s[1], -p, -s[0]) for k, s in enumerate(near))
    return out


def some_vectors(n=400, dims=6, scale=1.0):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0.5, 1) * scale for _ in range(dims)], 0 if k % 3 else rng.randrange(4), "x", "y") for k in range(n)]
    inf = float("inf")
    odd = [(n, None, 1), (n + 1, [1.0, None] + [0.0] * (dims - 2), 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [inf] + [1.0] * (dims - 1), 2), (20, rows[3][1], None), (None, rows[4][1], 1),
           (n + 4, [], 1), (n + 5, [3.0, 2.0], 1)]
    return [*rows, *((*r, None, None) for r in odd), rows[0], rows[0], rows[7], *[(n + 10 + k, rows[5][1], k % 2, "", "") for k in range(20)]]


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives_equal_all_pairs(spark, block):
    rows = some_vectors()
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(4), F.col("vec_id") % 20 == 0, block_rows=block).collect()
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 200
    assert Counter(map(tuple, got)) == want


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = some_vectors(80, scale=4e5)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, scale=256.0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 20 == 0)
    with pytest.raises(OverflowError):
        hardneg.hard_negatives(spark.createDataFrame(some_vectors(20, scale=1e8), VECTORS), F.col("vec_id") % 20 == 0)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hardneg.hard_negatives(empty, F.col("vec_id") % 20 == 0).count() == 0
    rows = spark.createDataFrame(some_vectors(30), VECTORS)
    assert hardneg.hard_negatives(rows, F.lit(False)).count() == 0


def test_best_is_mergeable():
    rng = np.random.default_rng(5)
    score, ids = rng.integers(0, 40, (6, 900)), rng.permutation(900)
    whole, parts = hardneg.Best(6, 5), hardneg.Best(6, 5)
    allowed = rng.random((6, 900)) < 0.7
    whole.take(np.arange(6), score, allowed, ids, ids)
    for k in range(0, 900, 77):
        parts.take(np.arange(6), score[:, k : k + 77], allowed[:, k : k + 77], ids[k : k + 77], ids[k : k + 77])
    want = [sorted((-score[s, k], ids[k]) for k in np.flatnonzero(allowed[s]))[:5] for s in range(6)]
    for best in (whole, parts):
        assert [[(-r[1], r[2]) for r in best.rows if r[0] == s] for s in range(6)] == want


def brute_base(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    again = {k + j for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(ws) < 10 or 100 * len(again) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(again), failed


def grams(text, bits):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hs, hs[1:])]
    return [h & ((1 << bits) - 1) for h in hs + pairs]


def brute_scores(texts, trusted, bits, prior):
    size = 1 << bits
    raw, good = Counter(), Counter()
    for text, flag in zip(texts, trusted, strict=True):
        raw.update(grams(text, bits))
        good.update(grams(text, bits) if flag else [])
    share = lambda b: (raw[b] + 1) / (raw.total() + size)
    ratio = lambda b: round((math.log((good[b] + prior * size * share(b)) / (good.total() + prior * size)) - math.log(share(b))) * 2**20)
    return [sum(map(ratio, g)) / max(len(g), 1) / 2**20 for g in (grams(t, bits) for t in texts)]


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_quality_equals_plain_rules(spark, odd, odd_rows, small):
    ids = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 104, 104, None)], "id bigint")
    ratios = quality.fit_to_ids(odd, ids, bits=10, small=small)
    got = quality.judge(odd, ratios, into="score").select("doc_id", "text", "score.*").collect()
    texts, trusted = [r[1] for r in odd_rows], [r[0] in {0, 1, 2, 3, 104} for r in odd_rows]
    scores = dict(zip(texts, brute_scores(texts, trusted, 10, quality.PRIOR), strict=True))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in odd_rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.text)
        assert r.score == pytest.approx(scores[r.text], abs=1e-12)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_repeated_windows_and_lines_of_random_texts(spark):
    rng = random.Random(4)
    texts = [rng.choice([" ", "\n", "\x85"]).join(rng.choice("ab$é|") * rng.randrange(3) + rng.choice(["", "\t", "\x0b", "\x1f"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a b c d e a b c d e", "a b c d e f a b c d e", "x " * 40, "a b c d", "\n".join(["x y", "x y ", "x y", "", "", " "])]
    rows = quality.judge(spark.createDataFrame([(t,) for t in texts], "text string"), [0] * 16).select("text", "quality.*").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.text)


def test_quality_of_nothing(spark, empty):
    assert quality.fit(empty, F.lit(True), bits=4) == [0] * 16
    assert quality.judge(empty, [0] * 16).count() == 0


def test_quality_tells_junk_from_trusted_words(spark):
    rng = random.Random(6)
    clean = [make_text("en", 80, rng) for _ in range(120)]
    junk = [" ".join(w + "%%%" for w in make_text("en", 80, rng).split()) for _ in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(clean + junk)], "doc_id int, text string")
    ratios = quality.fit(docs, F.col("doc_id") < 60)
    kept = {r.doc_id for r in quality.judge(docs, ratios).filter("quality.kept").collect()}
    assert {k for k in kept if k >= 120} == set()
    assert len(kept) >= 118


def test_quality_runs_without_python(spark, odd):
    plan = quality.judge(odd, [0] * 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
