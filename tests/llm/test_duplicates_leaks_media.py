import hashlib
import random
import tarfile
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterlake.llm import decontam, linededup, media, simhash

from .conftest import SCHEMA, make_text


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(rows, radius=4):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [(r[0], prints[i], min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def test_golay_decodes_every_word_within_three_bits():
    g = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    code = words ^ g.error[g.syndrome(words)]
    assert (g.syndrome(code) == 0).all() and (np.bitwise_count(code ^ words) <= 3).all()
    assert len(np.unique(g.decode(np.arange(1 << 23, dtype=np.int32)))) == 4096


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_fingerprints_within_the_radius_share_a_key(x, flips):
    y = x
    for k in flips:
        y ^= 1 << k
    row, key = simhash.fuzzy_keys(np.array([x, y], np.uint64), simhash.Golay())
    assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_components_equal_all_pairs(spark, odd, odd_rows, empty):
    got = simhash.near_duplicates(odd).collect()
    want = [(d, p - (1 << 64) if p >> 63 else p, c) for d, p, c in brute_components(odd_rows)]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert simhash.near_duplicates(empty).count() == 0


def test_a_dense_cloud_and_a_chain(spark):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    cloud = {center ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for _ in range(400)}
    chain, x = [], rng.getrandbits(64)
    for k in range(60):
        chain.append(x)
        x ^= 0b1111 << (4 * (k % 15))
    far = [rng.getrandbits(64) for _ in range(200)]
    values = np.array(sorted({*cloud, *chain, *far}), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "p bigint")
    links = simhash.fingerprint_links(df)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    found = defaultdict(set)
    for v in values.view(np.int64).tolist():
        found[roots.get(v, v)].add(v)
    rows = {int(v): None for v in values.view(np.int64)}
    root = {v: v for v in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    signed, unsigned = values.view(np.int64).tolist(), values
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(unsigned[:i] ^ unsigned[i]) <= 4):
            root[find(signed[i])] = find(signed[j])
    want = defaultdict(set)
    for v in signed:
        want[find(v)].add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert links.count() < 20 * len(values)  # no square of the cloud


def brute_groups(rows, t=0.8):
    """Rows that stay: of each component of texts with 5-word shingle sets of Jaccard t or more, the first by id, null last."""
    sets = [frozenset(simhash.shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    stay = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        stay.setdefault(find(i), rows[i][0])
    return sorted((v is None, v or 0) for v in stay.values())


@pytest.mark.parametrize("small", [2, 32])
def test_near_copies_equal_all_pairs(spark, odd, odd_rows, empty, small):
    rng = random.Random(12)
    base = [[f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(300)] for _ in range(6)]
    rows = [(k, " ".join(b), "en", "s", 1) for k, b in enumerate(base)]
    for k in range(60):  # families of edited copies, at a similarity of 0.85 and more, and others that are far
        words = list(rng.choice(base[:3]))
        for _ in range(rng.choice([1, 2, 3, 80])):
            words[rng.randrange(300)] = f"own{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words), "en", "s", 1))
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA), small=small)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_groups(rows)
    kept = simhash.drop_near_copies(odd, small=small)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_groups(odd_rows)
    assert simhash.drop_near_copies(empty).count() == 0


def test_no_close_pair_of_a_key_is_lost():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    prints[10:] = prints[rng.integers(0, 3, 30)] ^ (np.uint64(1) << rng.integers(0, 64, (30, 2)).astype(np.uint64))
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {(i, j) for i in range(40) for j in range(i) if far[i, j] <= 31}
    every = lambda root, small: simhash.close_pairs(prints, root, 31, small)
    pairs, forest = every(np.arange(40), 100)
    assert not forest and {(max(p), min(p)) for p in pairs.tolist()} == want
    pairs, forest = every(np.arange(40), 8)
    assert forest and {(max(p), min(p)) for p in pairs.tolist()} <= want and len(pairs) < 40
    root = rng.integers(0, 5, 40)
    pairs, forest = every(root, 8)
    assert not forest and {(max(p), min(p)) for p in pairs.tolist()} == {(i, j) for i, j in want if root[i] != root[j]}


def test_recall_of_near_copies():
    """Of pairs whose five-word shingles are similar by 0.8 or a little more, nine in ten share a key within the radius."""
    rng, golay, found, n = random.Random(13), simhash.Golay(), 0, 0
    while n < 250:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400, 900]))]
        other = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.015, 0.024)))):
            other[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        one, two = (simhash.shingle_hashes(" ".join(w).encode(), 5) for w in (words, other))
        both = len(np.intersect1d(one, two))
        if not 0.8 <= both / (len(np.unique(one)) + len(np.unique(two)) - both) < 0.88:
            continue
        n += 1
        prints = np.array([simhash.two_prints(np.unique(h)) for h in (one, two)]).view(np.uint64)
        near = np.bitwise_count(prints[0] ^ prints[1]).sum() <= 31
        for kind in (0, 1):
            row, key = simhash.pair_keys(prints[:, kind].copy(), golay, kind)
            if near and set(key[row == 0].tolist()) & set(key[row == 1].tolist()):
                found += 1
                break
    assert found >= 0.9 * n


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontam.find_leaks(d, b, into="m", **kw).select("doc_id", F.explode("m").alias("m")).collect()
    return {(r.doc_id, r.m.item_id): r.m for r in found}


def test_leaks_are_found_with_small_edits_and_nothing_else(spark):
    rng = random.Random(8)
    item = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(400)}" for _ in range(n))
    items = [item(n) for n in (40, 25, 16, 60, 33)] + ["two words", "", None]
    other = [item(80) for _ in range(30)]
    docs = [f"{other[k]} {items[k].upper().replace(' ', ', ')}! {other[k + 9]}" for k in range(5)] + other
    trimmed = " ".join(items[3].split()[2:])
    docs += [f"{other[20]} {trimmed} {other[21]}", items[0], f"so two words here", None, "", " ".join(items[1].split()[:12])]
    got = leaks(spark, docs, items)
    n = 5 + len(other)
    assert {k for k in got if k[0] < n} == {(k, k) for k in range(5)}
    assert {k for k in got if k[0] >= n} == {(n, 3), (n + 1, 0), (n + 2, 5)}
    assert all(m.similarity >= 0.8 for m in got.values()) and got[0, 0].bits == 0 and got[0, 0].start_word == 80
    assert leaks(spark, docs, items, max_bytes=200).keys() == got.keys()
    assert leaks(spark, docs, []) == {} and leaks(spark, [None, ""], items) == {}


def brute_leaks(items, docs, threshold=0.8):
    """Every window of every document against every item, without fingerprints: the best, the earliest of equals."""
    index, out = decontam.ItemIndex([(k, t.encode()) for k, t in enumerate(items)]), {}
    for d, doc in enumerate(docs):
        hashes, _ = decontam.words([doc.encode()])
        for k, size in enumerate(index.lengths.tolist()):
            n, width = min(decontam.SHINGLE, size), min(size, len(hashes))
            found = [(index.similarity(k, decontam.shingles(hashes[s : s + width], n)), -s) for s in range(len(hashes) - width + 1)]
            alike, s = max(found, default=(0, 0))
            if alike >= threshold:
                out[d, k] = (-s, width - s, alike)
    return out


def test_leaks_equal_all_windows(spark):
    rng = random.Random(10)
    some = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(300)}" for _ in range(n)]
    shared = some(9)
    items = [some(rng.randrange(15, 60)) for _ in range(12)] + [shared + some(rng.randrange(4, 20)) for _ in range(5)] + [some(2), some(6), shared * 4]
    docs = []
    for item in items:
        for k in range(6):
            cut, foreign = list(item), [f"z{rng.randrange(10**6)}" for _ in range(k + 1)]
            if k % 3 == 0:
                cut[: len(foreign)] = foreign
            elif k % 3 == 1:
                cut[-len(foreign) :] = foreign
            else:
                cut[rng.randrange(len(cut))] = foreign[0]
            docs.append(" ".join([*some(rng.randrange(9)), *cut, *(cut if k == 4 else []), *some(rng.randrange(9))]))
    texts = [" ".join(x) for x in items]
    got = leaks(spark, docs, texts)
    assert {k: (m.start_word, m.end_word, m.similarity) for k, m in got.items()} == brute_leaks(texts, docs)
    assert len(got) > 30 and sum(m.bits > 10 for m in got.values()) > 3
    assert leaks(spark, docs, texts, radius=10).keys() < got.keys()


def test_leaks_of_odd_rows(odd, empty, spark):
    items = odd.sparkSession.createDataFrame([(k, r.text) for k, r in enumerate(odd.collect()) if r.doc_id in (0, 3, None)], "item_id bigint, text string")
    got = decontam.find_leaks(odd, items, into="_leaks").collect()
    assert len(got) == odd.count() and all(r._row == "x-_row" for r in got)
    assert {r.doc_id for r in got if r._leaks} >= {0, 3, None} and not [r for r in got if r.doc_id in (100, 101, 102, 104) and r._leaks]
    assert decontam.find_leaks(empty, items, into="m").count() == 0
    plan = decontam.find_leaks(odd, items, into="m").filter(F.size("m") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each text is searched once


def test_multi_index_gives_every_item_within_the_radius():
    rng = np.random.default_rng(3)
    items = [(k, " ".join(map(str, rng.integers(0, 50, 12))).encode()) for k in range(200)]
    index = decontam.ItemIndex(items, radius=10)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64) ^ index.prints[rng.integers(0, 200, 500)] & np.uint64(0xFFFFFFFFFFFFFF)
    w, i = index.candidates(prints, 12)
    near = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= 10
    assert sorted(zip(w.tolist(), i.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_payloads_come_back(spark, odd, odd_rows, empty):
    got = media.text_media(odd).collect()
    want = sorted((i is None, i or 0, hashlib.sha256(media.payload_of((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t, *_ in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(r.payload).hexdigest(), r.n_bytes) for r in got) == want
    assert all(len(r.payload) % 192 == 0 and r.payload for r in got)
    assert media.text_media(empty).count() == 0


def test_matches_do_not_depend_on_the_blocks(spark):
    """Frequencies are those of all items, and each block is a pass of its own with one Python call."""
    rng = random.Random(21)
    common = make_text("en", 8, rng)
    items = [(f"i{k}", f"{make_text('en', rng.randrange(4, 40), rng)} {common}") for k in range(120)] + [("i3", ""), (None, make_text("de", 30, rng)), ("twice", "one two three four five six"), ("twice", "one two three four five six")]
    docs = []
    for k in range(150):
        words = items[k % 120][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "und"])
        docs.append((k, f"{make_text('en', 5, rng)} {' '.join(words)} {make_text('de', 9, rng)}"))
    docs += [(200, items[121][1]), (201, items[122][1]), (202, None), (203, "")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")

    def found(max_bytes):
        out = decontam.find_leaks(d, b, into="m", max_bytes=max_bytes)
        assert out.columns == ["doc_id", "text", "m"]
        return {r.doc_id: [tuple(x) for x in r.m] for r in out.collect()}

    whole = found(1 << 24)
    assert sum(map(len, whole.values())) > 40 and len(whole) == len(docs)
    assert found(12_000) == whole
    plan = decontam.find_leaks(d, b, into="m", max_bytes=20_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0  # the blocks have been matched


def test_ids_of_any_text_come_back(spark):
    ids = ["x" * 5000, "null", "", "a\nb", "é/../ü", None, None, "1"]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id string, text string")
    got = media.text_media(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or "", r.payload.rstrip()) for r in got) == sorted((i is None, i or "", f"text {k}".encode()) for k, i in enumerate(ids))


def test_decoded_bytes_of_a_batch_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " " * 3_000_000) for k in range(12)], "doc_id int, text string").coalesce(1)
    got = media.text_media(docs).select("doc_id", "n_bytes", F.octet_length("payload").alias("p")).collect()
    assert sorted(r.doc_id for r in got) == list(range(12)) and {(r.n_bytes, r.p) for r in got} == {(3_000_000, 3_000_000)}


def test_archive_ranges_read_each_member_once(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, make_text("en", rng.randrange(300), rng), "en", "s", 1) for k in range(200)], SCHEMA).repartition(3)
    names = media.write_archives(docs, str(tmp_path))
    with tarfile.open(tmp_path / names[0]) as tar:
        assert all(media.decode_png(tar.extractfile(m).read()) for m in tar.getmembers())
    for size in ("700", "5000", "100000000"):
        assert sorted(int(r.member_id) for r in media.read_archives(spark, str(tmp_path), rangeBytes=size).collect()) == list(range(200))
    for p in tmp_path.glob("*.idx"):
        p.unlink()
    assert media.read_archives(spark, str(tmp_path), rangeBytes="3000").count() == 200


def test_a_failing_member_is_tried_again_alone(tmp_path):
    (tmp_path / "a.tar").write_bytes(b"")
    reader = media._Reader({"path": str(tmp_path), "tries": "3", "wait": "0"})
    reader.offsets = lambda store, part: iter([(0, "a"), (512, None), (1024, "c")])
    opened = []
    reader.open = lambda store, path: opened.append(path) or path
    calls = defaultdict(int)

    def member(f, at):
        calls[at] += 1
        if at == 1024 or (at == 512 and calls[at] < 3):
            raise OSError("lost")
        return f"m{at}", b"x"

    reader.member = member
    rows = [r for b in reader.read(media._Range("a.tar", 0, 2000)) for r in b.to_pylist()]
    assert [r["member"] for r in rows] == ["m0", "m512", None] and rows[2]["error"] == "OSError: lost" and dict(calls) == {0: 1, 512: 3, 1024: 3}
    assert len(opened) == 5 and [r["member_id"] for r in rows] == ["a", None, "c"]  # once, and anew behind each failure but the last
    reader.mode = "failfast"
    with pytest.raises(OSError):
        list(reader.read(media._Range("a.tar", 0, 2000)))


def test_damaged_images_are_refused():
    png = media.encode_png(b"some text")
    assert media.decode_png(png) == (media.payload_of(b"some text"), 9)
    for bad in (b"", png[:-1], png[:40] + b"?" + png[41:], b"x" + png[1:]):
        with pytest.raises((ValueError, Exception)):
            media.decode_png(bad)


@pytest.mark.parametrize("layout", ["shuffled", "joined"])
def test_results_on_rows_do_not_depend_on_how_the_input_is_computed(spark, tmp_path, layout):
    """Row numbers of a frame that Spark computes again differ after column pruning: the input is written once."""
    rng = random.Random(12)
    rows = [(k, "\n".join(make_text("en", rng.randrange(3, 9), rng) for _ in range(rng.randrange(1, 6))), "en", f"s{k % 3}", 1) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + rng.choice(["", "\nand one more"]), "en", "s", 1) for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    other = files.select("doc_id", F.lit(1).alias("n"))
    docs = {"shuffled": files.repartition(7), "joined": files.join(other.hint("shuffle_hash"), "doc_id").repartition(5)}[layout]
    lines = {(r.doc_id, r.line_no): r.removed for r in linededup.similar_lines(docs).collect()}
    want = {(r.doc_id, r.line_no): r.removed for r in linededup.similar_lines(files).collect()}
    assert lines == want
    kept = {(r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert kept == {(r.doc_id, r.text) for r in linededup.dedup_lines(files).collect()}
    near = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert near == {r.doc_id for r in simhash.drop_near_copies(files).collect()} and len(near) < len(rows)
