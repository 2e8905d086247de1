"""Language-model scores: stupid backoff over word bigrams, computed relationally.

The model is counted over all texts and has all their words. A bigram seen at least ``min_count`` times scores
ln(c(u v) / c(u)); any other backs off to ln(0.4 c(v) / N); a text's first word scores ln(c(v) / N). A text's score is the
sum over its words.

Words are counted in a table partitioned by their hash. Occurrences of bigrams are dealt out by a hash of the bigram, as
arrays, so that counts and occurrences of one bigram meet in one place: there each occurrence gets its bigram's count, and
the parts are summed per document. Of the ``lexicon`` most frequent words at most, all executors have the counts; this only
makes rows shorter. A word beyond it is an occurrence of its own, counted where its hash is dealt, and what a repeated
bigram with such a word changes is found by joins with the word table. Bigrams of the ``head`` most frequent words would
make hot keys; their table is bounded by its number of cells, so it is summed up before the shuffle.

Words are told apart by XXH64: of n different words about n * n / 2**65 pairs would be taken for one.

Defined cases: null and empty texts have no words and score 0; bytes that aren't UTF-8 are words as any other; very long
texts are cut nowhere; null ids and repeated rows keep a row each; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, text_slices

BACKOFF = 0.4
SEED = 42  # of Spark's xxhash64
#: Kinds of occurrences: a bigram of lexicon words, another bigram, a word beyond the lexicon.
KNOWN, OTHER, WORD = 0, 1, 2


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts: lower-cased runs without white space."""
    text = F.lower(F.col(text_col))
    for space in "\t\n\x0b\f\r":  # a split at one blank needs no regular expression
        text = F.replace(text, F.lit(space), F.lit(" "))
    words = docs.select(F.explode(F.split(text, " ")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words, ``most`` at most: all from some level of counts on."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}  # 8 * 63 at most
    least, left = max(sizes, default=0) + 1, most
    while least - 1 >= 0 and sizes.get(least - 1, 0) <= left:
        least -= 1
        left -= sizes.get(least, 0)
    top = counts.filter(level >= least).select("hash", "n").toArrow()
    hashes, n = (top[c].to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


def backoff_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lexicon: int = 1 << 19, head: int = 255,
    min_count: int = 2, bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """One row a document: (id, n_tokens, n_backoff, score)."""
    if lexicon > 1 << 20:
        raise ValueError("lexicon ids have 20 bits")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col).cast("string")).alias("_text"))
    rows = numbered(rows, "_row")
    counts = cut(word_counts(rows, "_text").withColumn("hash", F.xxhash64("word")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(64, math.ceil(12 * total / bucket_bytes))
    words, seen = frequent(counts, lexicon)
    logs, log_n = np.log(np.maximum(seen, 1)), math.log(max(total, 1))
    heads = {r["word"].encode("utf-8", "surrogateescape"): k for k, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(head).collect())}
    shared, side = spark.sparkContext.broadcast((words, logs, heads)), len(heads)

    def cells(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places in the table of head bigrams, -1 for others."""
        return np.where((u >= 0) & (v >= 0), u * side + v, -1)

    def pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of every word that has one before it."""
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        second = np.flatnonzero(text[1:] == text[:-1]) + 1
        return text, second

    def count_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, table = shared.value[2], np.zeros(side * side + 1, np.int64)
        for batch in batches:
            for _, block in text_slices(batch.column(0)):
                split = [t.split() for t in block]
                flat = np.fromiter(map(heads.get, chain.from_iterable(split), repeat(-1)), np.int64)
                _, second = pairs(np.cumsum([0] + [len(ws) for ws in split]))
                table += np.bincount(cells(flat[second - 1], flat[second]) % len(table), minlength=len(table))
        found = np.flatnonzero(table[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(table[found])], names=["cell", "n"])

    table = np.zeros(side * side + 1, np.int64)
    found = rows.select("_text").mapInArrow(count_head, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[found["cell"].to_numpy()] = found["n"].to_numpy()  # at most head ** 2 rows
    shared_head = spark.sparkContext.broadcast(table)
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_row bigint, _id {id_type}, n_tokens bigint, n_backoff bigint, score double, bucket int, kind int, at array<int>, a array<bigint>, b array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, heads = shared.value
        table = shared_head.value
        kind_of = pa.list_(pa.int64())
        for batch in batches:
            row_ids, id_kind = batch.column(2).to_numpy(), batch.column(0).type
            for first, block in text_slices(batch.column(1)):
                split = [t.split() for t in block]
                starts, n = np.cumsum([0] + [len(ws) for ws in split]), len(split)
                own = row_ids[first : first + n]
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split), repeat(SEED)), np.uint64).view(np.int64)
                rank = np.fromiter(map(heads.get, chain.from_iterable(split), repeat(-1)), np.int64)
                ids = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
                known = words[ids] == hashes if len(words) else np.zeros(len(hashes), bool)
                log = np.where(known, logs[ids] if len(words) else 0.0, 0.0)
                text, second = pairs(starts)
                # As if every word but the first backed off; words beyond the lexicon are added where they are counted.
                part = log - log_n
                part[second] += math.log(BACKOFF)
                cell = cells(rank[second - 1], rank[second])
                in_head = cell >= 0
                times = np.where(in_head, table[cell], 0)
                hit, at = times >= min_count, second[in_head & (times >= min_count)]
                part[at] = np.log(times[hit]) - log[at - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own), batch.column(0).slice(first, n), pa.array(np.diff(starts)),
                        pa.array(np.bincount(text[second], minlength=n) - np.bincount(text[at], minlength=n)), pa.array(np.bincount(text, part, minlength=n).astype(float)),
                        pa.array((own % n_buckets).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, kind_of), pa.nulls(n, kind_of),
                    ],
                    names=names,
                )
                left = second[~in_head]
                both, new = known[left - 1] & known[left], np.flatnonzero(~known)
                inside, other = left[both], left[~both]
                for kind, at, a, b in (
                    (KNOWN, inside, ids[inside - 1] << 20 | ids[inside], None), (OTHER, other, hashes[other - 1], hashes[other]), (WORD, new, hashes[new], None),
                ):
                    mixed = (a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) if b is not None else np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                    bucket = ((mixed >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    used, ends = np.unique(bucket, return_counts=True)
                    k, offsets = len(used), pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(k, own[0])), pa.nulls(k, id_kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                            pa.array(used), pa.array(np.full(k, kind, np.int32)),
                            pa.ListArray.from_arrays(offsets, pa.array((own[text[at[order]]] - own[0]).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(a[order])),
                            pa.ListArray.from_arrays(offsets, pa.array(b[order])) if b is not None else pa.nulls(k, kind_of),
                        ],
                        names=names,
                    )

    dealt = rows.select("_id", "_text", "_row").mapInArrow(deal, schema).repartition("bucket")
    each = dealt.select("*", F.explode_outer(F.arrays_zip("at", "a", F.coalesce("b", "a").alias("b"))).alias("g")).select(
        (F.col("_row") + F.coalesce("g.at", F.lit(0))).alias("_row"), "_id", "n_tokens", "n_backoff", "score", "bucket", "kind", F.col("g.a").alias("a"), F.col("g.b").alias("b")
    )
    # Sorted by what tells most apart first: rows are compared by the leading column's bits, in full only where these are equal.
    counted = each.withColumn("c", F.count("*").over(Window.partitionBy("a", "b", "kind", "bucket")))
    table = spark.createDataFrame(pa.table({"w": np.arange(len(words)), "ln": logs}))
    one, two = (F.broadcast(table.select(F.col("w").alias(a), F.col("ln").alias(f"ln_{a}"))) for a in ("u", "v"))  # the lexicon
    repeated = F.col("c") >= min_count
    inside, other = (F.col("kind") == KNOWN) & repeated, (F.col("kind") == OTHER) & repeated
    known = counted.withColumn("u", F.when(inside, F.shiftright("a", 20))).withColumn("v", F.when(inside, F.col("a").bitwiseAND((1 << 20) - 1)))
    gain = F.ln("c") - F.lit(math.log(BACKOFF) - log_n)  # of a repeated bigram over backing off, but for ln c(u) + ln c(v)
    known = known.join(one, "u", "left").join(two, "v", "left").select(
        "_row", "_id", "n_tokens",
        F.when(F.col("kind").isNull(), F.col("n_backoff")).when(inside | other, F.lit(-1)).otherwise(F.lit(0)).alias("n_backoff"),
        F.when(F.col("kind").isNull(), F.col("score")).when(inside, gain - F.col("ln_u") - F.col("ln_v")).when(other, gain)
        .when(F.col("kind") == WORD, F.ln("c")).otherwise(F.lit(0.0)).alias("score"),
        F.when(other, F.col("a")).alias("a"), F.when(other, F.col("b")).alias("b"),
    )
    total_of = lambda df, *keys: df.groupBy(*keys).agg(
        F.max("_id").alias("_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_backoff").alias("n_backoff"), F.sum("score").alias("score"), F.count("*").alias("times")
    )
    parts = cut(total_of(known, "_row", "a", "b"))
    n_of = lambda a: counts.select(F.col("hash").alias(a), F.ln("n").alias(f"ln_{a}"))
    wide = parts.filter("a IS NOT NULL").join(n_of("a"), "a").join(n_of("b"), "b").withColumn("score", F.expr("score - times * (ln_a + ln_b)"))
    every = parts.filter("a IS NULL").drop("a", "b").unionByName(wide.select("_row", "_id", "n_tokens", "n_backoff", "score", "times"))
    return total_of(every, "_row").select(F.col("_id").alias(id_col), "n_tokens", "n_backoff", "score")
