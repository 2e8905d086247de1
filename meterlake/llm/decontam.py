"""Benchmark decontamination: SimHash windows of the benchmark items' own sizes.

Words are runs of letters and digits of the lower-cased text (any non-ASCII byte counts as a letter). A
sequence's features are its words, weighted by their rarity among the items; its 64-bit fingerprint has the
signs of the weighted sums of their hash bits. A window of a document that is as long as an item matches it if
its fingerprint is within ``radius`` bits of the item's, found by a multi-index of ``radius + 1`` bit blocks (fingerprints that
close agree in a whole block), and if the exact weighted Jaccard similarity of their shingles (five words, repeats included, rare
shingles weigh more) is 0.8 or more.

Which windows are fingerprinted an exact bound on shared shingle weight says first, as at this similarity fingerprints differ by
about 10 bits of 64 and blocks of so few bits select little: an item's most common shingles are left out of a lookup only
while they weigh less than 0.8 of it together, so any match holds one of the others, which names the item; then the
weight of all the item's shingles in a window, repeats beyond the item's own included, bounds the similarity from above. So the
multi-index confirms candidates rather than finds them, and may only drop what is beyond the radius
(of 1,193 edited items that are similar enough, one in ten is beyond 10 bits and none beyond 19; the radius is 24).

Rarity is counted over all items. An item's own words and shingles weigh by it, anything else in a window weighs most; so a
match depends on the item and the document alone. The items are taken to the executors in blocks of bounded size, one block
after another, and the benchmark may grow: each block is a pass over the documents, which are never shuffled, and what it finds
is written beside what the others found.

Defined cases: null and empty texts match nothing; bytes that aren't UTF-8 count as U+FFFD; very long texts are as any
other; repeated rows and null ids keep their rows; no column but the text is read, whatever the others' names; items without words are ignored; items shorter than five
words are one shingle; a document shorter than an item is one window; equal items are all reported; of one
item's windows the most similar counts, the earliest of equals; matches are listed by item id as text, nulls first; an empty benchmark
matches nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import cut, free_name, numbered, shared_dir, text_slices, worker_model

SHINGLE = 5
RADIUS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD_BYTE[128:] = True
#: Bytes hashed at a time.
_PART = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if n <= len(_UP):
        return _UP[:n], _DOWN[:n]
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP = _DOWN = np.zeros(0, np.uint64)
_UP, _DOWN = _powers(_PART + 1)


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and where each text's words start (one more at the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.diff(_WORD_BYTE[buf].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # in parts of bounded size that end between words
        at = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, at + _PART, "right")))
        hashes[k:to] = _word_hashes(buf[at : ends[to - 1]], starts[k:to] - at, ends[k:to] - at)
        k = to
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row; across all texts, the caller drops what crosses an end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _MIX + hashes[k : len(hashes) - n + 1 + k])
    return out


def _bit_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of the words' hash bits as +1 and -1; (windows, words) to (windows, 64)."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    return 2 * np.einsum("ijk,ij->ik", bits, weights) - weights.sum(1, keepdims=True)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def windows_with(hits: np.ndarray, reach: int, last: int) -> np.ndarray:
    """Starts, up to ``last``, of the windows that hold a hit: those from ``reach`` before one up to the hit itself."""
    opened = np.bincount(np.clip(hits - reach, 0, last), minlength=last + 2)
    return np.flatnonzero(np.cumsum(opened - np.bincount(np.minimum(hits + 1, last + 1), minlength=last + 2))[: last + 1] > 0)


def item_counts(texts: Iterable[bytes]) -> tuple[int, Counter, Counter]:
    """How many items have words, and by hash how many of them have a word and a shingle."""
    n, seen, spread = 0, Counter(), Counter()
    for text in texts:
        own, _ = words([text])
        if len(own):
            n += 1
            seen.update(set(own.tolist()))
            spread.update(set(shingles(own, min(SHINGLE, len(own))).tolist()))
    return n, seen, spread


@dataclass
class ItemIndex:
    """Fingerprints, multi-index and shingles of a block of items: (id, lower-cased UTF-8 text)."""

    items: list[tuple[object, bytes]]
    radius: int = RADIUS
    threshold: float = 0.8
    #: How many items there are in all, and by hash how many of them have a word and a shingle; None: these are all.
    counts: tuple[int, dict[int, int], dict[int, int]] | None = None
    ids: list = field(init=False)

    def __post_init__(self):
        hashes, at = words([t for _, t in self.items])
        kept = [k for k in range(len(self.items)) if at[k + 1] > at[k]]
        self.ids = [self.items[k][0] for k in kept]
        item_words = [hashes[at[k] : at[k + 1]] for k in kept]
        n, seen, spread = self.counts or item_counts(t for _, t in self.items)
        n = max(n, 1)
        self.word_weight = {w: self._rarity(n, seen[w]) for w in {w for x in item_words for w in x.tolist()}}
        self.new_weight = self._rarity(n, 0)
        self.own_words = []  # by item: its different words in order, and their weights
        for x in item_words:
            own = np.unique(x)
            self.own_words.append((own, np.array([self.word_weight[w] for w in own.tolist()], np.int64)))
        self.lengths = np.array([len(x) for x in item_words], np.int64)
        self.shingles = [shingles(x, min(SHINGLE, len(x))) for x in item_words]
        self.anchors = {}  # by shingle length: all items' shingles
        for size in sorted({min(SHINGLE, len(x)) for x in item_words}):
            self.anchors[size] = np.unique(np.concatenate([s for s, x in zip(self.shingles, item_words, strict=True) if min(SHINGLE, len(x)) == size]))
        self.shingle_weight = {s: self._rarity(n, spread[s]) for s in {s for x in self.shingles for s in x.tolist()}}
        self.anchor_weights = {k: np.array([self.shingle_weight[s] for s in known.tolist()], np.int64) for k, known in self.anchors.items()}
        self.shingle_totals = np.array([sum(map(self.shingle_weight.__getitem__, x.tolist())) for x in self.shingles], np.int64)
        self.names = self._names()
        self.prints = np.array([_pack(_bit_sums(x[None], self.weights(k, x)[None]))[0] for k, x in enumerate(item_words)], np.uint64)
        edges = np.linspace(0, 64, self.radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.by_size = {}
        for size in sorted(set(self.lengths.tolist())):
            own = np.flatnonzero(self.lengths == size)
            tables = []
            for shift, mask in self.blocks:
                value = (self.prints[own] >> shift) & mask
                order = np.argsort(value, kind="stable")
                tables.append((value[order], own[order]))
            self.by_size[size] = tables

    def _names(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By shingle length, (shingle, item) sorted by shingle: each item's shingles but its most common ones, which weigh less
        than the threshold of it together."""
        pairs = {n: ([], []) for n in self.anchors}
        for item, (own, length) in enumerate(zip(self.shingles, self.lengths.tolist(), strict=True)):
            counts, spare = Counter(own.tolist()), self.threshold * self.shingle_totals[item] * (1 - 1e-9)
            for s in sorted(counts, key=lambda s: (self.shingle_weight[s], s)):
                spare -= self.shingle_weight[s] * counts[s]
                if spare <= 0:
                    for column, x in zip(pairs[min(SHINGLE, length)], (s, item), strict=True):
                        column.append(x)
        out = {}
        for n, (found, items) in pairs.items():
            found, items = np.array(found, np.uint64), np.array(items, np.int64)
            order = np.argsort(found, kind="stable")
            out[n] = found[order], items[order]
        return out

    @staticmethod
    def _rarity(n: int, df: int) -> int:
        return round(16 * np.log2(1 + n / max(df, 1)))

    def weights(self, item: int, hashes: np.ndarray) -> np.ndarray:
        """The item's own words by their rarity, others as words no item has."""
        own, weights = self.own_words[item]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, weights[at], self.new_weight)

    def similarity(self, item: int, window: np.ndarray) -> float:
        one, two = Counter(self.shingles[item].tolist()), Counter(window.tolist())
        weight = lambda s: self.shingle_weight[s] if s in one else self.new_weight
        both = sum(weight(s) * min(c, two[s]) for s, c in one.items() if s in two)
        return both / (sum(weight(s) * c for s, c in one.items()) + sum(weight(s) * c for s, c in two.items()) - both)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, by shared blocks."""
        found = []
        for (shift, mask), (values, own) in zip(self.blocks, self.by_size[size], strict=True):
            value = (prints >> shift) & mask
            a, b = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            row = np.repeat(np.arange(len(prints)), b - a)
            col = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            item = own[col]
            near = np.bitwise_count(prints[row] ^ self.prints[item]) <= self.radius
            found.append(row[near] * len(self.prints) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)

    def match(self, hashes: np.ndarray, hits: dict[int, np.ndarray], rare: dict[int, np.ndarray]) -> list[tuple]:
        """(item id, first word, end word, differing bits, similarity) of one document. By shingle length, ``hits`` are
        where shingles of items are and ``rare`` where those are that name items."""
        best = {}
        for n, at in hits.items():
            if not len(rare[n]):
                continue
            every = shingles(hashes, n)
            known = every[at]
            weight = self.anchor_weights[n][np.searchsorted(self.anchors[n], known)]
            for item in self.named(n, every[rare[n]]).tolist():
                width = min(int(self.lengths[item]), len(hashes))
                mine = self._among(np.unique(self.shingles[item]), known)
                own = at[mine]
                starts = windows_with(own, width - n, len(hashes) - width)
                shared = np.concatenate([[0], np.cumsum(weight[mine])])
                a, b = np.searchsorted(own, starts), np.searchsorted(own, starts + (width - n + 1))
                both = np.minimum(shared[b] - shared[a], self.shingle_totals[item])
                total = shared[b] - shared[a] + self.new_weight * (width - n + 1 - (b - a))  # what the item doesn't have weighs most
                bound = both / (self.shingle_totals[item] + total - both)
                some = np.flatnonzero(bound >= self.threshold)
                some, bits = self.within(item, hashes, starts[some], width, some)
                found = None
                for k in np.argsort(-bound[some], kind="stable"):
                    if found and bound[some[k]] < found[4]:
                        break
                    s = int(starts[some[k]])
                    alike = self.similarity(item, every[s : s + width - n + 1])
                    if alike >= self.threshold and not (found and (-alike, s) >= (-found[4], found[1])):
                        found = (self.ids[item], s, s + width, int(bits[k]), alike)
                if found:
                    best[item] = found
        return [best[k] for k in sorted(best)]

    @staticmethod
    def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which values a sorted array has."""
        return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values

    def named(self, n: int, found: np.ndarray) -> np.ndarray:
        """The items that have one of these shingles among those that name them."""
        keys, items = self.names[n]
        found = np.unique(found)
        a, b = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
        return np.unique(np.concatenate([items[x:y] for x, y in zip(a, b, strict=True)]))

    def within(self, item: int, hashes: np.ndarray, starts: np.ndarray, width: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows those whose fingerprints the multi-index finds within the radius of the item, and the differing bits."""
        near, bits = [some[:0]], [np.zeros(0, np.int64)]
        step = max(1, (1 << 16) // width)
        for k in range(0, len(starts), step):
            words = hashes[starts[k : k + step, None] + np.arange(width)]
            prints = _pack(_bit_sums(words, self.weights(item, words)))
            row, other = self.candidates(prints, int(self.lengths[item]))
            row = row[other == item]
            near.append(some[k + row])
            bits.append(np.bitwise_count(prints[row] ^ self.prints[item]).astype(np.int64))
        return np.concatenate(near), np.concatenate(bits)

    def find(self, texts: list[bytes]) -> list[list[tuple]]:
        """Matches of each text."""
        hashes, at = words([t.decode("utf-8", "replace").lower().encode("utf-8") for t in texts])
        marks, rare = {}, {}
        for n, known in self.anchors.items():
            every = shingles(hashes, n)
            marks[n] = np.flatnonzero(self._among(known, every))
            rare[n] = marks[n][self._among(self.names[n][0], every[marks[n]])]
        out: list[list[tuple]] = [[] for _ in texts]
        hot = np.unique(np.concatenate([np.searchsorted(at, m, "right") - 1 for m in rare.values()])) if rare else []
        for d in hot:
            a, b = at[d], at[d + 1]
            inside = lambda m, n: m[np.searchsorted(m, a) : np.searchsorted(m, b - n, "right")] - a  # noqa: E731, B023
            out[d] = self.match(hashes[a:b], {n: inside(m, n) for n, m in marks.items()}, {n: inside(m, n) for n, m in rare.items()})
        return out


MATCH = "array<struct<item_id:{0},start_word:bigint,end_word:bigint,bits:int,similarity:double>>"


def matches_column(
    spark, items: list[tuple], item_type: DataType, text: Column, *, radius: int = RADIUS, threshold: float = 0.8, counts: tuple[int, dict, dict] | None = None
) -> Column:
    """All matches of a text with a bounded list of items."""
    pairs = [(i, (t or "").lower().encode("utf-8")) for i, t in items]
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), ("start_word", pa.int64()), ("end_word", pa.int64()), ("bits", pa.int32()), ("similarity", pa.float64())]))
    shared = spark.sparkContext.broadcast((pairs, counts))
    key = (hashlib.sha256(repr((pairs, counts and sorted(counts[1].items()))).encode()).hexdigest(), radius, threshold)

    names = ("item_id", "start_word", "end_word", "bits", "similarity")

    @F.arrow_udf(MATCH.format(item_type.simpleString()))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, counts = shared.value
        index = worker_model(key, lambda: ItemIndex(pairs, radius, threshold, counts))
        for texts in batches:
            found = [m for _, block in text_slices(texts) for m in (index.find(block) if index.ids else [[]] * len(block))]
            yield pa.array([[dict(zip(names, x, strict=True)) for x in m] for m in found], kind)

    return find.asNondeterministic()(text)  # else an explode of the matches has Spark find them twice


def frequencies(items: DataFrame) -> DataFrame:
    """(kind, hash, n, block) of the one text column and ``block``: how many of all items have a word (kind 0) or shingle (1), for each
    block that has it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, seen, spread = item_counts([(text or "").lower().encode("utf-8")])
                rows += [(kind, h - (1 << 63), block) for kind, known in ((0, seen), (1, spread)) for h in known]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "hash", "block"])

    found = items.mapInArrow(each, "kind int, hash bigint, block bigint").groupBy("kind", "hash", "block").agg(F.count("*").alias("n"))
    whole = found.groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    return whole.select("kind", "hash", "n", F.explode("blocks").alias("block"))


def _listed(items: DataFrame) -> list[tuple]:
    return sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is not None, str(r[0]), r[1] or ""))  # one block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    into: str = "matches", radius: int = RADIUS, threshold: float = 0.8, max_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with a column of the benchmark items each text holds (replaced if there is one of that name)."""
    spark, item_type = docs.sparkSession, benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    match = lambda some, counts: matches_column(spark, some, item_type, F.col(text_col), radius=radius, threshold=threshold, counts=counts)
    if n == 1:
        return docs.withColumn(into, match(_listed(items), None))
    # Blocks of about ``max_bytes``, dealt by a hash of the row; frequencies of all items, for each block those of what it has.
    dealt = cut(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))))
    known = cut(frequencies(dealt.select("text", "block")))
    row, own = free_name(docs, "_row"), free_name(docs, "_found")
    every = numbered(docs, row)
    found = f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}"
    n_items = _items_with_words(dealt)
    for k in range(n):
        some = _listed(dealt.filter(F.col("block") == k).select("id", "text"))
        table = known.filter(F.col("block") == k).select("kind", "hash", "n").toArrow().to_pydict()  # about as large as the block
        counts: tuple[int, dict, dict] = (n_items, {}, {})
        for kind, h, times in zip(table["kind"], table["hash"], table["n"], strict=True):
            counts[1 + kind][h + (1 << 63)] = times
        each = every.select(row, match(some, counts).alias(own)).filter(F.size(own) > 0)
        each.write.mode("append").parquet(found)
    place = F.transform(F.flatten(F.collect_list(own)), lambda x: F.struct(x["item_id"].isNotNull(), x["item_id"].cast("string"), x.alias("m")))
    matches = spark.read.parquet(found).groupBy(row).agg(F.transform(F.sort_array(place), lambda x: x["m"]).alias(own))
    empty = F.array().cast(MATCH.format(item_type.simpleString()))
    return every.join(matches, row, "left").withColumn(into, F.coalesce(own, empty)).select(*[c for c in docs.columns if c.lower() != into.lower()], into)


def _items_with_words(items: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(item_counts([(t or "").lower().encode("utf-8")])[0] for batch in batches for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return items.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
