import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm.packing import Capacity, WordEncoder, best_fit, pack_documents
from meterlake.llm.queries import tokenizer_path
from meterlake.llm.sharding import shard_by_bytes


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ ,.'s\n\t12éÄß!́ <|>"), st.characters(codec="utf-8")), max_size=60))
def test_word_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    if "t" not in globals():
        globals()["t"] = Tokenizer.from_file(tokenizer_path())
        globals()["t"].encode_special_tokens = True
        globals()["e"] = WordEncoder(tokenizer_path(), 0)
    ids = np.frombuffer(globals()["e"].encode([text])[0], "<u4").tolist()
    assert ids == globals()["t"].encode(text, add_special_tokens=False).ids + [0]


def test_a_part_of_ascii_words_is_encoded_once(tokenizer):
    encoder, text = WordEncoder(tokenizer_path(), 0), "(word) word's 'tword [word] word-word2 it's <word>! wörd-word ''s 12a"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert encoder.by_parts and {"word", "(", "]", "'s", "1"} <= encoder.parts.keys()


@pytest.mark.parametrize("cap", [Capacity(100), Capacity(100, 3, 4000), Capacity(100, rule="dot"), Capacity(100, 4, rule="dot")])
def test_best_fit_keeps_every_capacity(cap):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 61, 500)
    bins, offsets = best_fit(sizes, cap)
    limits = cap.vector()
    for b in set(bins.tolist()):
        own = sizes[bins == b]
        assert own.sum() <= limits[0] and len(own) <= limits[1] and (own**2).sum() <= limits[2]
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.cumsum(own[order]) - own[order]).all()
    if cap.documents > 100 and cap.cost is None:
        assert bins.max() + 1 <= -(-sizes.sum() // 100) + 2


def test_packing_of_odd_rows(odd, odd_rows, tokenizer):
    got = pack_documents(odd, tokenizer_path(), capacity=Capacity(256), block_tokens=20_000).collect()
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, zlib.crc32(bytes(r.token_ids))))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    want = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[doc_id] += [(k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_packing_of_nothing(empty):
    assert pack_documents(empty, tokenizer_path()).count() == 0


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(k, "x" * (50 + k % 90), "en", "s", 1) for k in range(6000)] + [(k, "copy " * 12, "en", "s", 1) for k in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint"), 16).toPandas()
    assert len(got) == len(rows)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() < 1.05 * sums.mean() and sums.min() > 0.95 * sums.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shards_of_odd_rows(odd, odd_rows, empty):
    got = shard_by_bytes(odd, 4).collect()
    key = lambda i, t: (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(key(i, t) for i, t, *_ in odd_rows)
    assert shard_by_bytes(empty, 4).count() == 0
