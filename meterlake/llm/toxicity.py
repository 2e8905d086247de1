"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (4 and 5 bytes of the lower-cased text) it contains. Each feature is
scaled by the log ratio of its smoothed shares among toxic and other training texts, and a logistic
regression is fitted on the scaled features. Training takes a bounded sample of labelled rows and runs in
one task; only the weights, 2**bits floats, reach the driver.

Defined cases: null text is the empty text and scores by the intercept alone; labels that are null count
as absent, of several labels of a document the largest holds; without both classes in the training rows
every score is the share of the class there is (0.5 if none). Equal texts score alike, ties included; repeated rows are scored each,
and a repeated id counts once in the sample; null ids are never labelled; very long texts are read whole, an n-gram counting once
however often it comes; what isn't UTF-8 counts as U+FFFD; an empty table gives an empty result; only the text is read to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, unit_hash, valid_text


@dataclass(frozen=True)
class Features:
    shortest: int = 4
    longest: int = 5
    bits: int = 18

    def of(self, text: bytes) -> np.ndarray:
        """The different hashed n-grams of a text, in rising order."""
        b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
        found = []
        key = np.zeros(len(b), np.uint64)
        for n in range(1, self.longest + 1):
            if n > len(b):
                break
            key = (key[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
            if n >= self.shortest:
                mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(64 - self.bits)).astype(np.int32))
        marks = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)
        return marks.astype(np.int32)


def fit(texts: list[bytes], labels: np.ndarray, prior: float, features: Features, *, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights by hash, then the intercept. ``prior``: the share of class 1 among all training rows."""
    size = 1 << features.bits
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        share = min(max(prior if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return np.append(np.zeros(size), np.log(share / (1 - share))).astype(np.float32)
    lists = [features.of(t) for t in texts]
    idx = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    pos = np.bincount(idx[y[row] == 1], minlength=size) + 1.0
    neg = np.bincount(idx[y[row] == 0], minlength=size) + 1.0
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    x = ratio[idx]
    norm = np.sqrt(np.bincount(row, x * x, minlength=len(lists)))
    x = x / np.maximum(norm.mean(), 1e-9)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) / len(y)
    bound = 0.25 * (np.bincount(row, x * x, minlength=len(lists)).max() + 1) * weight.max() * len(y) ** 0.5 + l2
    w, b, vw, vb, step = np.zeros(size), 0.0, np.zeros(size), 0.0, 1 / bound
    momentum = 0.9
    for _ in range(steps):
        score = np.bincount(row, x * (w + momentum * vw)[idx], minlength=len(lists)) + b + momentum * vb
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        grad = np.bincount(idx, x * error[row], minlength=size) + l2 * (w + momentum * vw) / len(y)
        vw, vb = momentum * vw - step * grad * 10, momentum * vb - step * error.sum() * 10
        w, b = w + vw, b + vb
    return np.append(w * ratio / np.maximum(norm.mean(), 1e-9), b).astype(np.float32)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    keep: Column | None = None, max_rows: int = 2000, features: Features = Features(),
) -> np.ndarray:
    """Weights learned from about ``max_rows`` rows of each class at most, chosen by a hash of the id.

    ``keep``: a condition on the id column of the label rows that may be learned from.
    """
    known = labels.select(F.col(id_col), F.col(label_col)).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        return fit([], np.zeros(0), 0.5, features)
    chance = F.when(F.col("_label") == 1, F.lit(max_rows / counts.get(1, 1))).otherwise(F.lit(max_rows / counts.get(0, 1)))
    some = known.filter(unit_hash(F.col(id_col), F.lit(23)) < chance)  # about 2 * max_rows rows
    rows = docs.select(F.col(id_col), valid_text(F.col(text_col)).alias("_text")).join(F.broadcast(some), id_col)
    rows = rows.groupBy(*some.columns).agg(F.min("_text").alias("_text"))  # one row an id, however often it is repeated
    prior = counts.get(1, 0) / sum(counts.values())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "_text"])
        weights = fit([(t or "").encode("utf-8") for t in pdf["_text"]], pdf["_label"].to_numpy(), prior, features)
        return pd.DataFrame({"weights": [weights.tobytes()]})

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else fit([], np.zeros(0), 0.5, features)


def toxic_score(spark, weights: np.ndarray, text: Column, *, features: Features = Features()) -> Column:
    """Chance that a text is toxic, 0 to 1."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in batches:
            sums = [float(w[features.of(t)].sum(dtype=np.float64)) for _, block in text_slices(texts) for t in block]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float) + float(w[-1]), -700, 700))))

    return score.asNondeterministic()(text)  # else a filter on the score has Spark compute it twice
