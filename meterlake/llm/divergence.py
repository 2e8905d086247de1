"""Source divergence audit: which sources of a language differ most, and the terms that set a source apart.

Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased. A language keeps the terms that at least
``min_docs`` of its documents have. Each (language, source) group and each language as a whole has a smoothed share of every
kept term, p = 1 + floor(10**9 (count + 2) / (N + 2 V)) of N counts and V terms, and two of them differ in a term by
floor((p - q)**2 / (p + q)). Two sources differ by the sum over all kept terms; a source's own terms are those it has more of
than its language.

Counts are added up in the tasks that read the texts and then by (language, term), one row a term with the counts of its
sources. Terms are dealt into blocks of about ``terms`` and sources into blocks of about ``sources``; a tile is a pair of
blocks of sources and a block of terms. For each, numpy fills two dense int64 matrices, group by term, and computes all
pairs by broadcasting, a few terms at a time; what comes out is a partial sum a pair, and the first terms of each source. The
block's terms that no source of the tile has are all alike: their difference is computed once and counted as often. Partial
sums are added up and first terms merged by Spark. No tile depends on the number of documents, and a source with a
third of them is one row of a matrix as any other. The table of languages is broadcast if it is small, else joined by a shuffle.

All arithmetic is exact: p is at most 10**9 + 1, so its square fits 64 bits; shares are divided in three steps of 10**3.

Defined cases: null text, lang and source are empty strings, a group like others; what isn't UTF-8 counts as U+FFFD; very long
texts are read whole; repeated rows count as often as they stand there; ties are ranked by the item's UTF-8 bytes; groups
without terms and languages without kept terms have their pairs (of value 0 if there are no terms); an empty table gives an empty
result; no other column is read, whatever its name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, valid_text

_OTHERS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: What isn't part of a term becomes a blank, A-Z become a-z.
_TABLE = bytes.maketrans(_OTHERS + bytes(range(0x41, 0x5B)), b" " * len(_OTHERS) + bytes(range(0x61, 0x7B)))
_PARTIAL = "lang string, source string, term string, n bigint, docs bigint"
_TILE = "lang string, kind string, source string, item string, value bigint"
#: Sums a task holds before it hands them on.
_HELD = 200_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split(b" ") if text else []


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of the columns (lang, source, text), added up within bounded parts of each task; a null term
    stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[bytes, list[int]]] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in sums.items():
                names = [None, *own]
                values = np.array([(0, 0), *own.values()], np.int64).reshape(-1, 2)
                term = pa.array(names, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), term, pa.array(values[:, 0]), pa.array(values[:, 1])], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = sums.setdefault((lang, source), {})
                before = len(own)
                found = Counter(terms_of(text.cast(pa.large_binary()).as_py()))
                found.pop(b"", None)
                for term, n in found.items():
                    got = own.get(term)
                    if got is None:
                        own[term] = [n, 1]
                    else:
                        got[0] += n
                        got[1] += 1
                held += len(own) - before
                if held >= _HELD:
                    yield from rows()
                    sums, held = {}, 0
        yield from rows()
        del sums
        release()

    return docs.mapInArrow(run, _PARTIAL)


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / (total + 2 terms)), exact for totals up to about 9 * 10**15."""
    below = np.asarray(total, np.int64) + 2 * terms
    whole, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(one: np.ndarray, two: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """For all pairs of rows the sum of their terms' differences; ``most`` numbers at a time."""
    out = np.zeros((len(one), len(two)), np.int64)
    step = max(1, most // max(1, out.size))
    for k in range(0, one.shape[1], step):
        out += differ(one[:, None, k : k + step], two[None, :, k : k + step]).sum(2)
    return out


def first_terms(counts: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> list[np.ndarray]:
    """Of each row the places of its first ``top`` terms: those it has and has more of than ``q``, the largest difference first, then
    by place."""
    out, f = [], differ(p, q)
    for have, value in zip((counts > 0) & (p > q), f, strict=True):
        at = np.flatnonzero(have)
        out.append(at[np.argsort(-value[at], kind="stable")[:top]])
    return out


def _tile(top: int):
    def run(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
        lang, left, right = (k.as_py() for k in key[:3])
        rows: list[tuple] = []
        sources, block, total = (groups.column(c).to_pylist() for c in ("source", "block", "total"))
        terms_of_lang, lang_total, in_block = (groups.column(c)[0].as_py() for c in ("terms", "lang_total", "in_block"))
        found = sorted(set(entries.column("term").to_pylist()), key=lambda x: x.encode())
        place = {t: k for k, t in enumerate(found)}
        every = np.zeros(len(found), np.int64)
        sides = {}
        for b in {left, right}:
            own = sorted((s, n) for s, n, k in zip(sources, total, block, strict=True) if k == b)
            sides[b] = [s for s, _ in own], np.zeros((len(own), len(found)), np.int64), np.array([n for _, n in own], np.int64)
        where = {s: (b, k) for b, (names, _, _) in sides.items() for k, s in enumerate(names)}
        for term, n, each in zip(entries.column("term").to_pylist(), entries.column("n").to_pylist(), entries.column("each").to_pylist(), strict=True):
            every[place[term]] = n
            for x in each:
                b, k = where[x["source"]]
                sides[b][1][k, place[term]] = x["n"]
        p = {b: shares(c, n[:, None], terms_of_lang) for b, (_, c, n) in sides.items()} if found else {b: c for b, (_, c, _) in sides.items()}
        one, two = sides[left][0], sides[right][0]
        sums = pair_sums(p[left], p[right])
        if in_block > len(found):  # terms that only sources of other blocks have: a share of none depends on the source's total
            none = {b: shares(np.zeros(len(n), np.int64), n, terms_of_lang) for b, (_, _, n) in sides.items()}
            sums += (in_block - len(found)) * differ(none[left][:, None], none[right][None, :])
        rows += [(lang, "pair", a, b, int(sums[i, j])) for i, a in enumerate(one) for j, b in enumerate(two) if left != right or i < j]
        if left == right and found:
            q = shares(every, lang_total, terms_of_lang)
            values = differ(p[left], q)
            for k, at in enumerate(first_terms(sides[left][1], p[left], q, top)):
                rows += [(lang, "term", one[k], found[t], int(values[k, t])) for t in at.tolist()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "kind", "source", "item", "value"])

    return run


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10,
    terms: int = 1024, sources: int = 64, small: int = 100_000,
) -> DataFrame:
    """(lang, source, part, item, value, rank): of part ``pair`` every other source of the language, of ``term`` the first ``top`` terms
    of the source's own."""
    read = lambda c: F.coalesce(valid_text(F.col(c)), F.lit(""))
    partial = partial_counts(docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text")))
    # Both groupings stand on one shuffle, by (lang, term).
    each = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = each.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("each")
    )
    counts = cut(by_term.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"))
    kept = counts.filter("term IS NOT NULL")

    groups = counts.filter("term IS NULL").select("lang", F.explode("each.source").alias("source"))
    of_group = kept.select("lang", F.explode("each").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    size = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("blocks"))
    langs = cut(size.join(of_lang, "lang", "left").select(
        "lang", "blocks", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.greatest(F.ceil(F.coalesce("terms", F.lit(0)) / terms), F.lit(1)).cast("int").alias("term_blocks"),
    ))
    langs = F.broadcast(langs) if langs.count() <= small else langs

    own = lambda name: F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")
    partners = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    tile = [F.least("block", "partner").alias("left"), F.greatest("block", "partner").alias("right")]
    placed = kept.join(langs, "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    in_block = placed.groupBy("lang", "term_block").agg(F.count("*").alias("in_block"))
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.transform("each", lambda x: own(x["source"])))))
    mine = F.filter("each", lambda x: own(x["source"]) == F.col("block"))
    entries = dealt.select("lang", "term_block", "term", "n", mine.alias("each"), "block", partners).select("lang", *tile, "term_block", "term", "n", "each")
    known = groups.join(of_group, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total", "term_blocks", own("source").alias("block"), "blocks"
    )
    meta = known.select("*", partners).select("*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
    meta = meta.join(in_block, ["lang", "term_block"], "left").withColumn("in_block", F.coalesce("in_block", F.lit(0)))
    meta = cut(meta.select("lang", *tile, "term_block", "source", "block", "total", "terms", "lang_total", "in_block"))
    keys = ["lang", "left", "right", "term_block"]
    found = cut(entries.groupBy(*keys).cogroup(meta.groupBy(*keys)).applyInArrow(_tile(top), _TILE))

    sums = found.filter("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    firsts = found.filter("kind = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(firsts.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
