"""Quality rules: what a text's words look like, and whether its n-grams are those of trusted texts.

Features are the hashes of a text's words and pairs of neighbouring words, each in one of ``2**bits`` buckets. ``fit`` counts
them over all documents (the raw corpus) and over the trusted ones, in one pass; both counts are multinomials over the
buckets, the raw one with one more count a bucket, the target one drawn towards the raw one by ``prior`` counts a bucket, so
that a bucket that trusted texts tell little about says little. A text's score is the sum of the log-likelihood ratios
(target against raw) of its n-grams by their number: long and short texts are held to the same threshold. A text whose score
is at least ``threshold`` is kept; there is no draw, so that a text is judged the same wherever it stands.

Everything is a DataFrame function: texts are never shuffled, an n-gram is counted in its task, and the only thing that is
collected is the table of buckets, whose size is a parameter. Ratios are whole multiples of 2**-20, so sums don't depend on
their order. The ids of trusted documents are broadcast up to a million; more of them are joined by a shuffle.

Words are ``[^\\x20\\x09-\\x0D]+``. Equal windows of five words are told by 64-bit hashes: in a text of n words about
n * n / 2**65 are taken for equal that aren't.

Defined cases: null, empty and blank texts have no words and fail; what isn't UTF-8 counts as U+FFFD; very long texts are read
whole (the work rises with n log n); repeated rows are rows of their own and count as often as they stand there; a null id is
never trusted; an id with labels that differ is trusted if one of them says so; an empty table gives an empty result, and
without trusted texts every score is 0; columns other than the text stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import valid_text

BITS = 14
PRIOR = 4.0
THRESHOLD = -0.15
#: Ratios are multiples of 2**-UNIT.
UNIT = 20
WINDOW = 5
_SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda in it uses the value for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blanked(text: Column) -> Column:
    """Every space character is a blank; replacing each costs a fraction of a translation of all characters."""
    for space in _SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(blanked(text), " "), "")


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words."""
    return _let(hashes, lambda h: F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x)))


def ngram_buckets(text: Column, bits: int = BITS) -> Column:
    """The buckets of all words and of all pairs of neighbouring words."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    every = _let(hashes, lambda h: F.concat(h, _pairs(h)))
    return F.transform(every, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that are found twice or more; ``hashes`` are those of the words in order."""

    def windows(h: Column) -> Column:
        hashed = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, window))))
        return F.slice(hashed, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0)))

    def covered(placed: Column) -> Column:
        """Of (window, place) sorted: words under windows that equal a neighbour."""
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        twice = F.filter(placed, lambda x, i: same(x, F.get(placed, i - 1)) | same(x, F.get(placed, i + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def counted(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(placed, covered))

    return _let(_let(hashes, windows), counted).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def fit(docs: DataFrame, trusted: Column, *, text_col: str = "text", bits: int = BITS, prior: float = PRIOR) -> list[int]:
    """For each bucket the log-likelihood ratio of trusted texts against all, in units of 2**-UNIT."""
    flagged = docs.select(F.coalesce(trusted, F.lit(False)).alias("good"), F.explode(ngram_buckets(valid_text(F.col(text_col)), bits)).alias("bucket"))
    counts = flagged.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good")).collect()  # 2**bits rows at most
    size = 1 << bits
    raw, good = [0] * size, [0] * size
    for bucket, n, k in counts:
        raw[bucket], good[bucket] = n, k
    n_raw, n_good, pull = sum(raw) + size, sum(good), prior * size
    share = [(x + 1) / n_raw for x in raw]
    return [round((math.log((g + pull * p) / (n_good + pull)) - math.log(p)) * (1 << UNIT)) for g, p in zip(good, share, strict=True)]


def _flags(docs: DataFrame, ids: DataFrame, id_col: str, flag: str, small: int) -> DataFrame:
    """``docs`` with a flag: whether the id is among ``ids`` (one column)."""
    known = ids.toDF(flag).filter(F.col(flag).isNotNull()).distinct()
    known = F.broadcast(known) if known.count() <= small else known
    return docs.join(known, docs[id_col] == known[flag], "left").withColumn(flag, F.col(flag).isNotNull())


def fit_to_ids(docs: DataFrame, ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = 1_000_000, **options: float) -> list[int]:
    """As ``fit``; the trusted documents are those whose id is in the one column of ``ids``."""
    flag = "_trusted" if id_col != "_trusted" else "_trusted_"
    flagged = _flags(docs.select(F.col(id_col), F.col(text_col)), ids, id_col, flag, small)
    return fit(flagged, F.col(flag), text_col=text_col, **options)


def judge(
    docs: DataFrame, ratios: list[int], *, text_col: str = "text", into: str = "quality", threshold: float = THRESHOLD, min_words: int = 10,
    most_repeated: int = 20,
) -> DataFrame:
    """``docs`` with a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (too few words, or over
    ``most_repeated`` per cent of them in repeated windows), score and kept (replaced if there is a column of that name)."""
    size = len(ratios)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded into one constant
    ratio = lambda x: F.get(table, x.bitwiseAND(F.lit(size - 1)).cast("int")).cast("bigint")
    total = lambda hs: F.aggregate(hs, F.lit(0).cast("bigint"), lambda a, x: a + ratio(x))

    def counted(t: Column, h: Column) -> Column:
        n = F.size(h)
        return F.struct(
            n.cast("bigint").alias("n_words"), F.char_length(F.replace(blanked(t), F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
            F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            duplicate_lines(t).cast("bigint").alias("n_dup_lines"), repeat_words(h).alias("n_repeat_words"),
            ((total(h) + total(_pairs(h))) / F.greatest(2 * n - 1, F.lit(1)) / F.lit(float(1 << UNIT))).alias("score"),
        )

    def judged(s: Column) -> Column:
        failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > most_repeated * s["n_words"])
        return F.struct(
            *(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), s["score"].alias("score"),
            (~failed & (s["score"] >= threshold)).alias("kept"),
        )

    # One expression, as columns between would be put into each other and computed again for each use.
    hashed = lambda t: F.transform(words(t), lambda w: F.xxhash64(w))
    verdict = _let(F.coalesce(valid_text(F.col(text_col)), F.lit("")), lambda t: _let(_let(hashed(t), lambda h: counted(t, h)), judged))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    return docs.select(*kept, verdict.alias(into))
