"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is learned from a bounded sample of labelled
texts: after each context, how often each byte came. A text's score under a language is its exact code
length with these frozen counts: a byte is coded after the longest context the language knows, with escape
probabilities of method C and exclusion of the bytes seen there, down to the flat order -1. The language
with the shortest code wins.

Contexts of all languages share one tree, so a position's context is found once, by at most ``order`` table
look-ups, for whole blocks of text at a time. Memory of a worker is about
``max_contexts * 1 KB * (languages + 1)``.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; so is every text if
there is nothing to learn from. Only text and language are learned from; repeated texts count once. Of languages with equal code
lengths the first by name wins. Ids are not read, so null and repeated ones don't matter; repeated rows are scored each; very long texts are
read whole, in blocks; bytes that aren't UTF-8 count as U+FFFD; an empty table gives an empty result; a column of the result's name is
replaced, other columns stay.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import padded, release, text_slices, unit_hash, valid_text, worker_model

UNDETERMINED = "und"


def training_sample(rows: DataFrame, label: str, text: str, *, max_rows: int, max_bytes: int, max_labels: int = 1000) -> DataFrame:
    """At most ``max_rows`` different texts and ``max_bytes`` a label, in the order of a hash of the text; the
    ``max_labels`` most frequent labels.

    A first pass counts rows a label; the second keeps about as many as are wanted by that hash alone, so
    that only these are shuffled, whatever the size of the table or of its largest label.
    """
    usable = rows.select(F.col(label).alias("_label"), valid_text(F.col(text)).alias("_text")).filter(
        F.col("_label").isNotNull() & (F.length("_text") > 0)
    )
    chance = F.least(F.lit(1.0), F.lit(1.5 * max_rows) / F.col("_n"))
    counts = usable.groupBy("_label").agg(F.approx_count_distinct(F.xxhash64("_text"), 0.02).alias("_n"))
    counts = counts.orderBy(F.desc("_n"), "_label").limit(max_labels)
    hashed = usable.withColumn("_h", unit_hash(F.col("_text"), F.lit(11)))
    some = hashed.join(F.broadcast(counts), "_label").filter(F.col("_h") < chance)
    once = some.groupBy("_label", "_h", F.xxhash64("_text").alias("_x")).agg(F.any_value("_text").alias("_text"))
    order = Window.partitionBy("_label").orderBy("_h", "_x")
    sized = once.withColumn("_bytes", F.sum(F.octet_length("_text")).over(order)).withColumn("_n", F.row_number().over(order))
    kept = sized.filter((F.col("_n") == 1) | ((F.col("_n") <= max_rows) & (F.col("_bytes") <= max_bytes)))
    return kept.select(F.col("_label").alias(label), F.col("_text").alias(text))


def count_contexts(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order 0..order: (context and next byte as one number, how often), the nearest byte lowest."""
    buf, starts, ends = padded(texts, order)
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]) if len(starts) else np.zeros(0, np.int64)
    key, out = buf[at].astype(np.int64), []
    for k in range(order + 1):
        if k:
            key = key | (buf[at - k].astype(np.int64) << (8 * k))
        out.append(np.unique(key, return_counts=True))
    return out


class ContextTree:
    """Code lengths in bits for (context, byte) under each language. ``counts``: language -> count_contexts."""

    def __init__(self, counts: dict[str, list], max_contexts: int):
        self.languages = sorted(counts)
        self.order = len(next(iter(counts.values()))) - 1
        contexts = self._contexts(counts, max_contexts)
        n = sum(map(len, contexts))
        first = np.cumsum([0] + [len(c) for c in contexts])
        #: Context 0 is the empty one, context n stands for none.
        self.child = np.full((n + 1, 256), n, np.int32)
        parent = np.zeros(n, np.int32)
        for k in range(1, self.order + 1):
            ids = first[k] + np.arange(len(contexts[k]))
            parent[ids] = first[k - 1] + np.searchsorted(contexts[k - 1], contexts[k] & ((1 << (8 * (k - 1))) - 1))
            self.child[parent[ids], contexts[k] >> (8 * (k - 1))] = ids
        self.bits = np.empty((len(self.languages), n + 1, 256), np.float32)
        for own, lang in zip(self.bits, self.languages, strict=True):
            own[:] = self._bits(counts[lang], contexts, first, parent)

    @staticmethod
    def _contexts(counts: dict[str, list], max_contexts: int) -> list[np.ndarray]:
        """Of all languages' contexts seen twice, the most frequent; a context's suffixes are always with it."""
        keys, sums, orders = [], [], []
        n_orders = len(next(iter(counts.values())))
        for k in range(n_orders):
            every = np.concatenate([c[k][0] for c in counts.values()])
            ctx, inverse = np.unique(every >> 8, return_inverse=True)
            keys.append(ctx)
            sums.append(np.bincount(inverse, np.concatenate([c[k][1] for c in counts.values()])))
            orders.append(np.full(len(ctx), k))
        key, total, order = map(np.concatenate, (keys, sums, orders))
        top = np.lexsort((key, order, -total))[:max_contexts]
        top = top[(total[top] >= 2) | (order[top] == 0)]
        return [np.sort(key[top][order[top] == k]) for k in range(n_orders)]

    def _bits(self, counts: list, contexts: list, first: np.ndarray, parent: np.ndarray) -> np.ndarray:
        n = int(first[-1])
        seen = np.zeros((n, 256), np.float32)
        for k, (keys, times) in enumerate(counts):
            at = np.searchsorted(contexts[k], keys >> 8)
            known = (at < len(contexts[k])) & (contexts[k][np.minimum(at, len(contexts[k]) - 1)] == keys >> 8) if len(contexts[k]) else np.zeros(len(keys), bool)
            seen[first[k] + at[known], (keys & 255)[known]] = times[known]
        p = np.empty((n + 1, 256))  # chance of a byte after a context
        rest = np.empty((n, 256))  # the same once it is known that the context's own bytes are excluded
        for k in range(len(contexts)):
            s = slice(int(first[k]), int(first[k + 1]))
            c, own = seen[s].astype(float), seen[s] > 0
            total, kinds = c.sum(1, keepdims=True), own.sum(1, keepdims=True)
            if k == 0:
                below = np.where(own, 0, 1 / np.maximum(256 - kinds, 1))
            else:
                up = parent[s]
                left = np.where(own, 0, seen[up])
                sums, new = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
                esc = np.where(sums + new > 0, new / np.maximum(sums + new, 1), 1.0)
                below = np.where(left > 0, left / np.maximum(sums + new, 1), esc * rest[up])
                below = np.where(own, 0, below)
            esc = np.where(kinds == 256, 0, kinds / np.maximum(total + kinds, 1))
            rest[s] = below
            p[s] = np.where(own, c / np.maximum(total + kinds, 1), esc * below)
            unseen = total[:, 0] == 0  # not in this language's tree: its longest known suffix codes
            if unseen.any():
                if k == 0:
                    p[s], rest[s] = 1 / 256, 1 / 256
                else:
                    rows = np.arange(s.start, s.stop)[unseen]
                    p[rows], rest[rows] = p[parent[rows]], rest[parent[rows]]
                    seen[rows] = seen[parent[rows]]
        p[n] = 1
        return -np.log2(np.maximum(p, 1e-12)).astype(np.float32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        buf, starts, ends = padded(texts, self.order)
        none = len(self.child) - 1
        state = deepest = np.zeros(len(buf), np.int32)
        child = self.child.reshape(-1)
        for k in range(1, self.order + 1):
            before = np.concatenate([np.zeros(k, np.uint8), buf[: len(buf) - k]])
            state = child[state * 256 + before]
            deepest = np.where(state == none, deepest, state)
        at = deepest * 256 + buf
        out = np.empty((len(texts), len(self.languages)))
        for j, bits in enumerate(self.bits):
            sums = np.concatenate([[0.0], np.cumsum(bits.reshape(-1)[at], dtype=np.float64)])
            out[:, j] = sums[ends] - sums[starts]
        return out


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: int = 4, max_rows: int = 400, max_bytes: int = 1 << 19) -> bytes:
    """The languages' context counts, learned from a ``training_sample`` of these bounds."""
    sample = training_sample(rows, lang_col, text_col, max_rows=max_rows, max_bytes=max_bytes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode("utf-8") for t in pdf[text_col]]
        return pd.DataFrame({"lang": [str(pdf[lang_col].iloc[0])], "counts": [pickle.dumps(count_contexts(texts, order))]})

    found = sample.groupBy(lang_col).applyInPandas(one, "lang string, counts binary").collect()  # one row a language
    return pickle.dumps({r["lang"]: pickle.loads(r["counts"]) for r in found})


def language_of(spark, model: bytes, text: Column, *, max_contexts: int = 12_288) -> Column:
    """Struct (lang, score, bits_per_byte) of a text column. The score is the posterior chance of the
    winner if all languages are as likely beforehand."""
    shared, key = spark.sparkContext.broadcast(model), (hashlib.sha256(model).hexdigest(), max_contexts)

    def build() -> ContextTree | None:
        counts = pickle.loads(shared.value)
        return ContextTree(counts, max_contexts) if counts else None

    @F.arrow_udf("lang string, score double, bits_per_byte double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = worker_model(key, build)
        for texts in batches:
            langs, scores, rates = [], [], []
            for _, block in text_slices(texts, 1 << 19):  # a byte takes about 60 of temporary arrays
                bits = tree.code_lengths(block) if tree else np.zeros((len(block), 1))
                best = bits.argmin(1)
                less = bits - bits.min(1, keepdims=True)
                scores.append(1 / np.exp2(-np.minimum(less, 1000)).sum(1))
                langs += [tree.languages[b] if tree else UNDETERMINED for b in best]
                rates.append(bits.min(1) / np.maximum([len(b) for b in block], 1))
            columns = [pa.array(langs, pa.string()), *(pa.array(np.concatenate([np.zeros(0), *x])) for x in (scores, rates))]
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "bits_per_byte"])
        release()

    found = predict.asNondeterministic()(text)  # else Spark may copy the call into filters and score each text twice
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, found).otherwise(
        F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    )


def identify(docs: DataFrame, train_rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there is one of that name)."""
    model = train(train_rows, text_col=text_col, lang_col=lang_col)
    return docs.withColumn(into, language_of(docs.sparkSession, model, F.col(text_col)))
