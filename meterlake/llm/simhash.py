"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text's 64-bit fingerprint has three segments of 23, 23 and 18 bits, each a word (the last padded with
zeros) of the perfect Golay code [23, 12, 7]. ``near(x)`` are the codeword indices that the words within one
bit of x decode to, about five; two words at most one bit apart have the decoding of either one among both
sets, and two words at most two bits apart share a neighbour and so an index.

Fingerprints at most four bits apart have two segments with at most two errors between them (the segment with
most errors left out). For each pair of segments (i, j) the keys are
  (decode(i), each of near(j)) and (each of near(i), decode(j)): errors (0|1, 0|1),
  (bits of i, each of near(j)) and (each of near(i), bits of j): errors (0, 2) and (2, 0),
about 60 keys of 24 to 35 bits a fingerprint, and every link shares one. Fingerprints that share a key are
compared bit by bit; of a large group only a spanning forest of its links comes out, never all pairs.
Components follow by alternating stars. Equal fingerprints are one node, so copies cost nothing, and the
nodes around a hot text are bounded by the 64-bit words within the radius.

That is for fingerprints within a radius. ``drop_near_copies`` wants texts whose shingle sets (five words) have a Jaccard
similarity of 0.8 or more. There fingerprints differ by about ten bits of 64, so each text has two independent ones, the
keys are all pairs of near(i) and near(j), about 170 a text, and what shares a key and is within 31 of the 128 bits is
verified on the whole texts. By a simulation of such fingerprints 91 % of the pairs at a similarity of 0.8 share a key, 97 %
at 0.85, 99 % at 0.9; a pair lost may still be in one group by others. In a key's large group a spanning forest is
verified first, then every pair that it leaves unconnected. Keys are dealt in buckets of bounded size, packed in 20 bytes each. They
have 24 bits: with N texts a key is shared by chance by 28 N / 2**24, which grows with the corpus.

Defined cases: texts without words (null, empty, blank) have fingerprint zero and are linked like any other;
null ids are ignored for component ids (last, where one document stays); repeated rows are members; bytes that aren't UTF-8
are words as any other; very long texts are read whole; an empty table gives an empty result; components that don't settle
in ``max_rounds`` raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, numbered, release, text_slices

RADIUS = 4
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and width
GENERATOR = 0xC75  # fixed value: x^11+x^10+x^6+x^5+x^4+x^2+1, a generator of the Golay code


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit k is 1 if it is set in over half the XXH64 hashes of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t, shingle) for _, block in text_slices(texts) for t in block]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(text)


class Golay:
    """Decoding of 23-bit words: the index, 0 to 4095, of the one codeword at most three bits away."""

    def __init__(self):
        self.syndromes = np.zeros(1 << 12, np.int32)  # of the upper 12 bits; the lower 11 are their own
        for bit in range(12):
            s = 1 << (bit + 11)
            for k in range(bit + 11, 10, -1):
                if s >> k & 1:
                    s ^= GENERATOR << (k - 11)
            at = np.arange(1 << 12)
            self.syndromes[(at >> bit & 1) == 1] ^= s
        bits = [1 << k for k in range(23)]
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
        errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        errors = np.array(errors, np.int32)
        self.error = np.zeros(1 << 11, np.int32)
        self.error[self.syndrome(errors)] = errors

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.syndromes[words >> 11] ^ (words & 0x7FF)

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the different codeword indices that each word and its one-bit neighbours decode to."""
        flips = np.array([0, *(1 << k for k in range(width))], np.int32)
        found = np.sort(self.decode(words[:, None] ^ flips), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        rows, cols = np.nonzero(new)
        return rows, found[rows, cols]


def fuzzy_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys are longs of which the upper bits name the segments and the kind."""
    words = [((prints >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int32) for a, w in SEGMENTS]
    exact = [golay.decode(w) for w in words]
    near = [golay.near(w, width) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    rows, keys = [], []
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for mode, left, (row, code), flip in ((0, exact[i], near[j], False), (0, exact[j], near[i], True), (1, words[i], near[j], False), (2, words[j], near[i], False)):
            one, two = left[row].astype(np.int64), code.astype(np.int64)
            key = (two << 12 | one) if flip else (one << 12 | two)
            rows.append(row)
            keys.append(key | (kind * 3 + mode + 1) << 40)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints: each is compared only with those not reached yet."""
    left, out = prints, []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = np.bitwise_count(left ^ x) <= radius
            out += [(int(x), int(y)) for y in left[hit]]
            stack += list(left[hit])
            left = left[~hit]
    return out


def links_of_sorted(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS, small: int = 6) -> list[np.ndarray]:
    """Links (n, 2) among rows with equal keys; rows are sorted by key. All links of small groups, a forest of others."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size, out = np.repeat(sizes, sizes), []
    for d in range(1, small):
        a = np.flatnonzero((keys[:-d] == keys[d:]) & (size[:-d] <= small)) if len(keys) > d else np.zeros(0, np.int64)
        far = np.bitwise_count(prints[a] ^ prints[a + d])
        a = a[(far <= radius) & (far > 0)]
        out.append(np.stack([prints[a], prints[a + d]], axis=1))
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        forest = spanning_links(np.unique(prints[s : s + n]), radius)
        if forest:
            out.append(np.array(forest, np.uint64))
    return out


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a < b) that connect whatever fingerprints of the one-column frame are at most four bits apart."""
    if radius > 4:
        raise ValueError("the keys guarantee links up to four bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(every), 20_000):
                part = every[k : k + 20_000]
                row, key = fuzzy_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys, values = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            if held is not None:
                keys, values = np.concatenate([held[0], keys]), np.concatenate([held[1], values])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            held = keys[last:], values[last:]
            yield from links(keys[:last], values[:last])
        if held is not None:
            yield from links(*held)

    def links(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            pairs = np.concatenate(links_of_sorted(keys, values.view(np.uint64), radius)).view(np.int64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = prints.mapInArrow(emit, "key bigint, print bigint")
    dealt = keys.repartition("key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Alternating stars:
    each node's neighbours move to its smallest one until nothing moves."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.filter("m <> u").select("u", F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = cut(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """Rows (id, fingerprint as a signed long, component_id), one a document."""
    rows = cut(docs.select(F.col(id_col).alias("_id"), fingerprint_column(F.col(text_col), shingle).alias("_print")))
    nodes = rows.groupBy("_print").agg(F.min("_id").alias("_least"))
    roots = components(fingerprint_links(rows.select("_print").distinct(), radius))
    known = nodes.join(roots, nodes["_print"] == roots["node"], "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root")
    )
    named = known.groupBy("_root").agg(F.min("_least").alias("_component"))
    labels = known.select("_print", "_root").join(named, "_root").select("_print", "_component")
    return rows.join(labels, "_print").select(
        F.col("_id").alias(id_col), F.col("_print").alias("fingerprint"), F.col("_component").alias("component_id")
    )


_FLIP = np.uint64(0xA0761D6478BD642F)
_ODD = np.uint64(0xE7037ED1A0B428DB)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words (of all words if they are fewer)."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    found = (xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(n if words else 0))
    return np.fromiter(found, np.uint64)


def two_prints(hashes: np.ndarray) -> tuple[int, int]:
    """Independent fingerprints of a set of shingles: of the hashes, and of the hashes mixed once more."""
    if not len(hashes):
        return 0, 0
    ones = np.zeros(128, np.int64)
    for k in range(0, len(hashes), 4096):
        h = hashes[k : k + 4096]
        again = (h ^ (h >> np.uint64(29)) ^ _FLIP) * _ODD
        both = np.stack([h, again ^ (again >> np.uint64(32))], axis=1).astype("<u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    one, two = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").tolist()
    return one, two


def pair_keys(prints: np.ndarray, golay: Golay, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each pair of segments all pairs of near indices."""
    words = [((prints >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int32) for a, w in SEGMENTS]
    near = [golay.near(w, width) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    rows, keys = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (row, one), (other, two) = near[i], near[j]
        first = np.searchsorted(other, np.arange(len(prints) + 1))
        times = (first[1:] - first[:-1])[row]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[row], times)
        rows.append(np.repeat(row, times))
        keys.append(np.repeat(one.astype(np.int64) << 12, times) | two[at] | (kind * 3 + k + 1) << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _far(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ two).sum(-1)


def close_pairs(prints: np.ndarray, root: np.ndarray, radius: int, small: int) -> tuple[np.ndarray, bool]:
    """Pairs of places of the (n, 2) prints of one key within the radius: all between different roots if there are up to
    ``small`` prints or some already have a common root, else a spanning forest; and whether it is a forest."""
    n, out = len(prints), []
    if n > small and len(np.unique(root)) == n:
        left = np.arange(n)
        while len(left):
            stack, left = [left[0]], left[1:]
            while stack and len(left):
                x = stack.pop()
                hit = _far(prints[left], prints[x]) <= radius
                out += [(x, y) for y in left[hit]]
                stack += list(left[hit])
                left = left[~hit]
        return np.array(out, np.int64).reshape(-1, 2), True
    names, at, size = np.unique(root, return_inverse=True, return_counts=True)
    largest = size.argmax()
    for x in np.flatnonzero(at != largest) if len(names) > 1 else ():  # a pair of the largest root's own needs no look
        y = np.flatnonzero((at != at[x]) & ((at == largest) | (np.arange(n) > x)))
        out += [(x, k) for k in y[_far(prints[y], prints[x]) <= radius]]
    return np.array(out, np.int64).reshape(-1, 2), False


_PACKED = "bucket int, rows binary"
_ENTRY = np.dtype([("key", "<i4"), ("one", "<i8"), ("two", "<i8")])
#: Bytes of keys that a bucket should have.
_BUCKET_BYTES = 16 << 20


def packed_keys(nodes: DataFrame, n_buckets: int) -> DataFrame:
    """All keys of (one, two), dealt into buckets by key: a row has those of some thousand nodes for one bucket, 20 bytes each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            one, two = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            for k in range(0, len(one), 5000):
                found = []
                for kind, own in enumerate((one, two)):
                    at, key = pair_keys(own[k : k + 5000].view(np.uint64), golay, kind)
                    rows = np.empty(len(at), _ENTRY)
                    rows["key"], rows["one"], rows["two"] = key, one[k + at], two[k + at]
                    found.append(rows)
                rows = np.concatenate(found)
                bucket = (rows["key"].astype(np.uint32) * np.uint32(0x9E3779B1)) % np.uint32(n_buckets)
                order = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                parts = np.split(rows[order], first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "rows"])

    return nodes.mapInArrow(emit, _PACKED)


def _candidates(keyed: DataFrame, radius: int, small: int, packed: bool = False) -> DataFrame:
    """Pairs (a, a2, b, b2) with null key of rows that share a key, and the rows of large groups again. ``keyed`` has rows (key, one,
    two, root), or is ``packed``: as yet each node is its own root."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            last = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0  # the last key may go on
            held = rows[last:].copy()
            yield from groups(rows[:last])
        if held is not None:
            yield from groups(held)

    def compare_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for own, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != bucket:
                    yield from unpacked(held)
                    bucket, held = own, []
                held.append(part.as_py())
        yield from unpacked(held)

    def unpacked(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        found = np.frombuffer(b"".join(parts), _ENTRY)
        found = found[np.lexsort((found["two"], found["one"], found["key"]))]
        _, again, size = np.unique(found["key"], return_inverse=True, return_counts=True)
        found = found[size[again] > 1]  # most keys are of one node alone
        for k in _cuts(found["key"]):
            part = found[k]
            rows = np.stack([part["key"].astype(np.int64), part["one"], part["two"], np.arange(len(part))], axis=1)
            yield from groups(rows)

    def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        key, print_, root = rows[:, 0], rows[:, 1:3].view(np.uint64), rows[:, 3]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        size, pairs, later = np.repeat(sizes, sizes), [], []
        few = min(small, 64)  # groups up to this size at once: each row with the one d rows on
        for d in range(1, few):
            x = np.flatnonzero((size[:-d] > d) & (size[:-d] <= few) & (key[:-d] == key[d:]) & (root[:-d] != root[d:])) if len(rows) > d else []
            x = x[_far(print_[x], print_[x + d]) <= radius] if len(x) else []
            if len(x):
                pairs.append(np.concatenate([rows[x, 1:3], rows[x + d, 1:3]], axis=1))
        for a, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
            group = rows[a : a + n]
            found, forest = close_pairs(group[:, 1:3].view(np.uint64), group[:, 3], radius, small)
            pairs.append(np.concatenate([group[found[:, 0], 1:3], group[found[:, 1], 1:3]], axis=1))
            if forest and len(found):
                later.append(group)
        pairs = np.concatenate([np.zeros((0, 4), np.int64), *pairs])
        swap = (pairs[:, 0] > pairs[:, 2]) | ((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] > pairs[:, 3]))
        pairs[swap] = pairs[swap][:, [2, 3, 0, 1]]
        pairs = np.unique(pairs, axis=0)
        later = np.concatenate([np.zeros((0, 4), np.int64), *later])
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, *map(pa.array, pairs.T)], names=["key", "a", "a2", "b", "b2"])
        yield pa.RecordBatch.from_arrays([*map(pa.array, later.T), pa.nulls(len(later), pa.int64())], names=["key", "a", "a2", "b", "b2"])

    out = "key bigint, a bigint, a2 bigint, b bigint, b2 bigint"
    if packed:
        return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare_packed, out)
    return keyed.repartition("key").sortWithinPartitions("key", "one", "two").mapInArrow(compare, out)


def _cuts(keys: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Slices of sorted keys of about ``most`` rows that end with a key."""
    at = 0
    while at < len(keys):
        to = min(at + most, len(keys))
        to = to if to == len(keys) else int(np.searchsorted(keys, keys[to - 1], "right"))
        yield slice(at, to)
        at = to


def drop_near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 31, small: int = 32,
) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the smallest id (null last), of equal ids the first row.
    Texts with the same two fingerprints are one node if they are similar to its first text. An input that isn't read plainly
    from files is written first."""
    row = free_name(docs, "_row")
    every = numbered(docs, row)
    text = F.col(text_col).cast("string")

    @F.arrow_udf("one long, two long, exact long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for _, block in text_slices(texts):
                for t in block:
                    hashes = np.unique(shingle_hashes(t, shingle))
                    found.append((*two_prints(hashes), xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)))
            one, two, exact = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.StructArray.from_arrays([pa.array(one), pa.array(two), pa.array(exact)], names=["one", "two", "exact"])
        release()

    @F.arrow_udf("array<bigint>")
    def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for _, block in text_slices(texts) for t in block]
            yield pa.array(found, pa.list_(pa.int64()))

    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    rows = every.select(place.alias("place"), prints.asNondeterministic()(text).alias("p")).select("place", "p.*")
    sets = cut(rows.groupBy("one", "two", "exact").agg(F.min("place").alias("place")))  # texts of equal shingle sets are one
    first = F.min(F.struct("place", "exact"))
    nodes = cut(sets.groupBy("one", "two").agg(first.alias("f"), F.count("*").alias("k")).select("one", "two", "f.place", "k"))
    # From here a node is its two prints; other sets of the same prints are compared with the node's first.
    again = sets.join(nodes.filter("k > 1").select("one", "two", F.col("place").alias("head")), ["one", "two"]).filter("place <> head")

    def similar(pairs: DataFrame) -> DataFrame:
        """Of pairs of rows (x, y) those whose shingle sets are similar."""
        wanted = pairs.select(F.col("x").alias(row)).union(pairs.select("y")).distinct()
        texts = every.select(row, text.alias("t")).join(wanted, row)
        found = cut(texts.select(row, shingle_set.asNondeterministic()(F.col("t")).alias("s")))
        one, two = (found.select(F.col(row).alias(k), F.col("s").alias(f"{k}_s")) for k in ("x", "y"))
        both = F.size(F.array_intersect("x_s", "y_s"))
        alike = pairs.join(one, "x").join(two, "y").filter(both >= F.lit(similarity) * (F.size("x_s") + F.size("y_s") - both) - 1e-9)
        return cut(alike.select("x", "y"))

    def rows_of(found: DataFrame) -> DataFrame:
        side = lambda k, a: nodes.select(F.col("one").alias(a), F.col("two").alias(f"{a}2"), F.col("place.row").alias(k))
        return cut(found.filter("key IS NULL").select("a", "a2", "b", "b2").distinct().join(side("x", "a"), ["a", "a2"]).join(side("y", "b"), ["b", "b2"]).select("x", "y"))

    n_buckets = max(64, nodes.count() * 180 * _ENTRY.itemsize // _BUCKET_BYTES)
    found = cut(_candidates(packed_keys(nodes.select("one", "two"), n_buckets), radius, small, packed=True))
    links = similar(rows_of(found).union(again.select(F.col("place.row").alias("x"), F.col("head.row").alias("y"))))
    large = found.filter("key IS NOT NULL").select("key", F.col("a").alias("one"), F.col("a2").alias("two"))
    if not large.isEmpty():
        roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        named = nodes.select("one", "two", F.col("place.row").alias("r")).join(roots, F.col("r") == F.col("node"), "left")
        named = named.select("one", "two", F.coalesce("root", "r").alias("root"))
        rest = cut(_candidates(large.join(named, ["one", "two"]).select("key", "one", "two", "root"), radius, 1 << 62))
        links = links.union(similar(rows_of(rest)))
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = sets.join(roots, F.col("place.row") == F.col("node"), "left").select("place", F.coalesce("root", "place.row").alias("root"))
    stays = known.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return every.join(stays, row, "left_semi").select(*docs.columns)
