"""Line dedup: an exact set-similarity join of all lines, then removal of every later match.

A line is the set of its white-space separated, lower-cased words. Tokens are ordered by rarity (by the logarithm of
the corpus count of their hash bucket, so that a frequent token never looks rare, then by hash), and two lines are
candidates if they share a token of their prefixes: with Jaccard similarity of at least t, the larger must have one
among its first n - ceil(t n) + 1 tokens that is among the first n - ceil(2 t / (1 + t) n) + 1 of the smaller. The
length filter, the positional filter (what can still overlap after the shared token) and a parity bitmap of the sets,
which bounds the overlap from above, thin them out; the rest is verified on the whole word sets. A line goes if any
line at least as similar as t stands before it, by document id and line number.

Lines of equal word sets are one class from the start, so copies are never paired, and classes are numbered in the order
of their first lines. All links between different classes are counted, those within a large group without making pairs: in
lists of a rare token of ``core_list`` or more, the classes near the earliest one are a group with a core, the words that most of
them have, and two classes whose differences from it add up to few enough are similar, whatever these are; how many differ by
how much decides how many such links a class has. The join makes all other pairs, those that only common differences
make similar among them: within a group it compares the differences themselves, and near misses are no candidates. If only what goes is asked for (``links=False``), a large
group of similar lines costs in proportion to its size: in every list of a prefix token of ``long_list`` or more, each class is first compared with the earliest one, and what that removes needs no other match. A
class's candidates are verified earliest first, the others only if that fails.

Only DataFrame functions run on the executors; the driver turns the collected table of bucket levels into one value.
Word sets are told apart by 64 bits of XXH64 and words, when verified, by 64 bits each: of
n different sets about n * n / 2**65 pairs would be taken for one. Prefixes have 32 bits, which can only add candidates.

Defined cases: lines without a word match nothing and stay; null texts have no lines and stay null; null ids come
last, equal ids (repeated rows) in the order of the input; long lines are as any other; an empty table gives an empty
result; columns of the input other than id and text are not read by ``similar_lines``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_to, free_name, numbered, release, remove, stable

#: Tokens are counted in so many buckets of their hashes; the table of their levels, a byte each, is sent with the plan.
BUCKETS = 1 << 20
_LEVELS = 32
#: Sets of so many words have a bitmap of 128 bits, as 64 are about half full for any of them.
_LONG = 80


def _words(text: Column) -> Column:
    """Lower-cased words, with empty ones between; a split at one blank needs no regular expression."""
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(F.lower(text), " ")


def word_set(line: Column) -> Column:
    """Sorted hashes of a line's different words."""
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def token_levels(sets: DataFrame) -> Column:
    """An array: for each bucket of tokens a number that rises with the logarithm of its count over all lines. It is a scalar
    subquery, as the plan's text, of which the driver keeps many copies, would spell out a literal."""
    each = sets.select(F.explode("tokens").alias("x")).select(F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))
    level = F.least(F.lit(_LEVELS - 1), F.floor(F.log2(F.count("*")))).cast("tinyint")
    counted = each.groupBy("bucket").agg(level.alias("level")).toArrow()  # one row a bucket at most, 5 bytes each
    table = np.zeros(BUCKETS, np.int8)
    table[counted["bucket"].to_numpy()] = counted["level"].to_numpy()
    rows = pa.table({"levels": pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), pa.array(table))})
    one = cut(sets.sparkSession.createDataFrame(rows))
    del counted, table
    release()
    return one.scalar()


def _level(levels: Column, token: Column) -> Column:
    return F.get(levels, token.bitwiseAND(F.lit(BUCKETS - 1)))


def _need(n: str, share: float) -> str:
    """Length of the prefix of n tokens that must meet an overlap of ``share`` of them."""
    return f"CAST({n} - ceil({share} * {n} - 1e-9) + 1 AS INT)"


def _may_match(t: float) -> str:
    """Length and bitmap filter; true for every pair at least as similar as t."""
    return f"least(x_n, y_n) >= {t} * greatest(x_n, y_n) - 1e-9 AND x_n + y_n - bit_count(x_bits ^ y_bits) >= 2 * {_overlap(t)}"


def _long_may_match(t: float) -> str:
    """The same of two long sets by both halves of their bitmaps."""
    halves = "bit_count(x_more ^ y_more) + bit_count(x_bits ^ y_bits ^ x_more ^ y_more)"
    return f"(least(x_n, y_n) < {_LONG} OR x_n + y_n - ({halves}) >= 2 * {_overlap(t)})"


def _overlap(t: float) -> str:
    return f"ceil({t / (1 + t)} * (x_n + y_n) - 1e-9)"


def _side(df: DataFrame, side: str, key: str) -> DataFrame:
    return df.select(key, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key))


def _line_sets(lines: DataFrame) -> DataFrame:
    """The lines: ids, hash of the word set, its size and 32 bits of each word."""
    sets = lines.withColumn("_set", word_set(F.col("line")))
    return sets.select(
        "_id", "_row", "line_no", F.xxhash64("_set").alias("set_id"), F.size("_set").alias("n"),
        F.transform("_set", lambda x: F.shiftright(x, 32).cast("int")).alias("tokens"),
    )


def _numbered_classes(sets: DataFrame, t: float) -> DataFrame:
    """One row a word set: ``c`` rises with the place of its first line; prefix and bitmap of those that can match another."""
    levels = token_levels(sets)
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("line_no").alias("line"))
    # A lambda may not hold a subquery before the plan is optimized; the column is put into its place then. An array that can't have
    # nulls is sorted as numbers.
    sets = sets.withColumn("levels", levels)
    ranked = F.transform("tokens", lambda x: F.coalesce(x + F.shiftleft(_level(F.col("levels"), x).cast("bigint"), 32), F.lit(0)))
    rarest = F.transform(F.slice(F.sort_array(ranked), F.lit(1), F.expr(_need("n", t))), lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int"))
    alone = F.lit(t >= 1) | (F.col("n") < t / max(1 - t, 1e-9) - 1e-9)  # sets this small are similar to none but themselves
    prefix = F.when(alone, F.array().cast("array<int>")).otherwise(rarest)
    bits = F.expr("aggregate(tokens, 0L, (a, x) -> a ^ shiftleft(1L, x))")
    more = F.expr(f"IF(n < {_LONG}, 0L, aggregate(tokens, 0L, (a, x) -> IF(x & 64 = 0, a, a ^ shiftleft(1L, x))))")
    each = sets.select("set_id", place.alias("place"), "n", prefix.alias("prefix"), bits.alias("bits"), more.alias("more"))
    classes = each.groupBy("set_id").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "prefix", "bits", "more")))
    return cut(classes.repartitionByRange("place").sortWithinPartitions("place").withColumn("c", F.monotonically_increasing_id()))


def _few(df: DataFrame, most: int) -> DataFrame:
    """The frame, read from files, to be broadcast if it has ``most`` rows or less."""
    return F.broadcast(df) if df.count() <= most else df


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()


def _sets_of(wanted: DataFrame, classes: DataFrame, lines: DataFrame, small: int) -> DataFrame:
    """(c, s): the whole word sets of the wanted classes (c)."""
    where = cut(wanted.join(classes, "c").select("c", F.col("place.row").alias("_row"), F.col("place.line").alias("line_no")))
    found = lines.join(_few(where, small), ["_row", "line_no"])
    return cut(found.select("c", word_set(F.col("line")).alias("s")))


def _similar(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Those of the pairs (x, y) whose word sets are as similar as t."""
    one, two = (sets.select(F.col("c").alias(k), F.col("s").alias(f"{k}_s")) for k in ("x", "y"))
    both = F.size(F.array_intersect("x_s", "y_s"))
    alike = pairs.join(one, "x").join(two, "y").filter(both >= F.lit(t) * (F.size("x_s") + F.size("y_s") - both) - 1e-9)
    return alike.select("x", "y")


def _verified(pairs: DataFrame, classes: DataFrame, lines: DataFrame, t: float, small: int) -> DataFrame:
    """For each x of the pairs (x, y) that is similar to a y: (x, match), where match is the earliest y if that is similar,
    else the earliest similar one of the others. Places of up to ``small`` classes (three numbers each) are broadcast."""
    sets = _sets_of(_ends(pairs), classes, lines, small)
    similar = lambda some: cut(_similar(some, sets, t).groupBy("x").agg(F.min("y").alias("match")))
    first = similar(pairs.groupBy("x").agg(F.min("y").alias("y")))
    others = pairs.join(first, "x", "left_anti")
    return first.union(similar(others))


def _groups(classes: DataFrame, lines: DataFrame, t: float, small: int, core_list: int) -> DataFrame | None:
    """(c, lead, n, d, diff) of classes in long lists of a token that are near the earliest class ``lead`` of such a list: diff are the
    d words in which a class differs from the core of its group, the words that over half of the group have."""
    rarest = classes.select("c", F.explode(F.slice("prefix", 1, 3)).alias("token"))
    lists = cut(rarest.groupBy("token").agg(F.count("*").alias("k"), F.min("c").alias("c")).filter(F.col("k") >= core_list).drop("k"))
    if lists.isEmpty():
        return None
    heads = cut(classes.select("c", F.col("n").alias("y_n"), F.col("bits").alias("y_bits")).join(_few(lists, small), "c").withColumnRenamed("c", "lead"))
    posting = classes.select("c", F.col("n").alias("x_n"), F.col("bits").alias("x_bits"), F.explode("prefix").alias("token"))
    near = posting.join(_few(heads, small), "token").filter(F.expr(_may_match(t)))
    members = cut(near.groupBy("c").agg(F.min("lead").alias("lead")))
    for _ in range(2):  # a group whose earliest class is in another one is a part of that
        up = members.withColumnsRenamed({"lead": "up", "c": "lead"}).filter("up < lead").join(members.select("lead").distinct(), "lead", "left_semi")
        members = cut(members.join(_few(cut(up), small), "lead", "left").select("c", F.coalesce("up", "lead").alias("lead")))
    sets = cut(_sets_of(members.select("c"), classes, lines, small).join(_few(members, small), "c"))
    half = sets.groupBy("lead").agg((F.count("*") / 2).alias("half"))
    words = sets.select("lead", F.explode("s").alias("w")).groupBy("lead", "w").agg(F.count("*").alias("k"))
    core = cut(words.join(half, "lead").filter("k > half").groupBy("lead").agg(F.collect_list("w").alias("core")))
    words = F.coalesce("core", F.array().cast("array<bigint>"))
    diff = F.concat(F.array_except("s", words), F.array_except(words, "s"))
    each = sets.join(_few(core, small // 100), "lead", "left").select("c", "lead", F.size("s").alias("n"), diff.alias("diff"))
    return cut(each.withColumn("d", F.size("diff")))


def _surely(x: str, y: str, t: float) -> str:
    """Of a group: whether two classes are similar because of how much they differ from the core; if not, they may be yet."""
    need = _overlap(t).replace("x_n", f"{x}n").replace("y_n", f"{y}n")
    return f"({x}n + {y}n - {x}d - {y}d >= 2 * {need})"


def _by_words(t: float) -> str:
    """Of two classes of a group that are not surely similar: whether they are, as they share so many differences from the core."""
    return f"(x_n + y_n - x_g.d - y_g.d + 2 * size(array_intersect(x_g.diff, y_g.diff)) >= 2 * {_overlap(t)})"


def _sure_links(groups: DataFrame, t: float, small: int) -> DataFrame:
    """(x, y, links): how many others of its group a class is surely similar to, and the earliest one."""
    kinds = groups.groupBy("lead", "n", "d").agg(F.count("*").alias("k"), F.min("c").alias("c"))
    every = kinds.groupBy("lead").agg(F.collect_list(F.struct("n", "d", "k", "c")).alias("kinds"))
    test = _surely("x.", "y.", t)
    links = f"aggregate(kinds, 0L, (a, y) -> a + IF({test}, y.k, 0L)) - IF({_surely('x.', 'x.', t)}, 1L, 0L)"
    each = f"transform(kinds, x -> struct(x.n, x.d, {links} AS links, array_min(transform(filter(kinds, y -> {test}), y -> y.c)) AS y))"
    sure = cut(every.select("lead", F.expr(f"inline({each})")).filter("links > 0"))
    return groups.join(_few(sure, small), ["lead", "n", "d"]).select(F.col("c").alias("x"), "y", "links")


def _linked(pairs: DataFrame, sure: DataFrame | None, classes: DataFrame, lines: DataFrame, t: float, small: int) -> DataFrame:
    """(x, match, links) of all classes that are similar to another one: how many, and the earliest if that is earlier than x.
    ``sure`` are those that are no pairs."""
    sets = _sets_of(_ends(pairs), classes, lines, small)
    alike = cut(_similar(pairs, sets, t)).withColumn("links", F.lit(1).cast("bigint"))
    each = alike.union(alike.select(F.col("y").alias("x"), F.col("x").alias("y"), "links"))
    each = each if sure is None else each.union(sure)
    return cut(each.groupBy("x").agg(F.min(F.when(F.col("y") < F.col("x"), F.col("y"))).alias("match"), F.sum("links").alias("links")))


def _led(posting: DataFrame, classes: DataFrame, lines: DataFrame, t: float, small: int, long_list: int, rounds: int) -> DataFrame | None:
    """(x, match) of classes in long lists of a token that are similar to the earliest class of such a list. Those removed
    leave the lists, and what is left is compared with its own earliest one, ``rounds`` times at most; the rest of the
    pairs is the main join's."""
    count = lambda df: df.groupBy("token").agg(F.count("*").alias("k"), F.min("c").alias("y")).filter(F.col("k") >= long_list)
    heads, known, lists = cut(count(posting).select("token", "y")), None, posting
    for _ in range(rounds):
        if heads.isEmpty():
            break
        leader = cut(heads.join(classes.select(F.col("c").alias("y"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits")), "y"))
        lists = cut(lists.join(leader, "token").filter("c > y").select("token", "c", "n", "bits", "y", "y_n", "y_bits"))
        near = lists.select(F.col("c").alias("x"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"), "y", "y_n", "y_bits").filter(F.expr(_may_match(t)))
        pairs = cut(near.select("x", "y").distinct())
        if pairs.isEmpty():
            break
        found = cut(_verified(pairs, classes, lines, t, small))
        known = found if known is None else known.union(found)
        lists = lists.select("token", "c", "n", "bits").join(found.select(F.col("x").alias("c")), "c", "left_anti")
        heads = cut(count(lists).select("token", "y"))
    return known


def similar_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, small: int = 1_000_000,
    long_list: int = 128, rounds: int = 1, links: bool = True, core_list: int = 32,
) -> DataFrame:
    """One row a line with words: (id, _row, line_no, class_id, match_id, removed), and n_links if ``links``.

    ``class_id`` names the line's word set; ``match_id`` is that of an earlier similar set, if there is one: the line's
    representative pair, the earliest one if ``links``. ``n_links`` is how many other sets are similar, all of a large group
    of similar lines among them; without it a group costs in proportion to its size. ``removed`` lines are copies of an earlier line or have such a match. ``_row`` is the document's
    place in the input; an input that isn't read plainly from files is written first.
    """
    t = similarity
    rows = numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "_row")
    lines = rows.select("_id", "_row", F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    # Written before the filter, which would else be taken below and find all words twice; hashes don't compress.
    sets, place = cut_to(_line_sets(lines), compression="none", **{"parquet.enable.dictionary": "false"})
    classes = _numbered_classes(sets.filter("n > 0"), t)
    sets = cut(sets.filter("n > 0").drop("tokens", "n"))
    remove(docs.sparkSession, place)

    def postings(some: DataFrame) -> DataFrame:
        """(token, c, bits, more, meta) and the group ``g``: meta has n, the token's position, whether the class is still open and
        whether the token is in the shorter prefix."""
        group = [c for c in ("g",) if c in some.columns]
        every = some.select("c", "n", "bits", "more", "open", *group, F.posexplode("prefix").alias("at", "token"))
        fewer = F.expr(f"IF(at < {_need('n', 2 * t / (1 + t))}, 1L, 0L) + IF(open, 2L, 0L)")
        return every.select("token", "c", "bits", "more", *group, (F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(F.col("at").cast("bigint"), 2) + fewer).alias("meta"))

    # A quarter of the tokens is enough to find large groups, and so are the lists of the rarest three; one missed is left to
    # the main join.
    some = None if links else postings(classes.withColumn("open", F.lit(True))).filter("meta & 1 = 1 AND token & 3 = 0").select("token", "c", F.shiftright("meta", 32).alias("n"), "bits")
    known = None if some is None else _led(some, classes, lines, t, small, long_list, rounds)
    groups = _groups(classes, lines, t, small, core_list) if links else None
    settled = None if known is None else known.select(F.col("x").alias("c"), F.lit(True).alias("settled"))
    open_ = classes.withColumn("settled", F.lit(None).cast("boolean")) if settled is None else classes.join(settled, "c", "left")
    open_ = open_.withColumn("open", F.col("settled").isNull())
    open_ = open_ if groups is None else open_.join(_few(groups.select("c", F.struct("lead", "d", "diff").alias("g")), small // 8), "c", "left")
    # The larger set of a pair by its whole prefix, the smaller by its short one; x is the later of the two.
    late = "IF(x_c > y_c, x_meta, y_meta) & 2 = 2"
    test = f"x_c <> y_c AND x_n >= y_n AND {late} AND {_may_match(t)} AND least(x_n - x_at, y_n - y_at) >= {_overlap(t)} AND {_long_may_match(t)}"
    if groups is not None:
        sure = _surely("x_", "y_", t).replace("_d", "_g.d")
        test += f" AND IF(coalesce(x_g.lead = y_g.lead, false), NOT {sure} AND {_by_words(t)}, true)"
    for k in "xy":
        test = test.replace(f"{k}_n", f"shiftright({k}_meta, 32)").replace(f"{k}_at", f"shiftright({k}_meta & 4294967295, 2)")
    every = postings(open_)
    pairs = _side(every, "x", "token").join(_side(every.filter("meta & 1 = 1"), "y", "token"), "token").filter(F.expr(test))
    pairs = pairs.select(F.greatest("x_c", "y_c").alias("x_c"), F.least("x_c", "y_c").alias("y_c"))
    pairs = cut(pairs.select(F.col("x_c").alias("x"), F.col("y_c").alias("y")).distinct())
    sure = None if groups is None else _sure_links(groups, t, small)
    matches = _linked(pairs, sure, classes, lines, t, small) if links else _verified(pairs, classes, lines, t, small)
    matches = matches if known is None else matches.union(known)
    counts = ["links"] if links else []
    named = classes.select(F.col("c").alias("match"), F.col("set_id").alias("match_id"))
    match = matches.join(named, "match", "left").select(F.col("x").alias("c"), "match_id", *counts)
    known_sets = classes.select("c", "set_id", "place").join(match, "c", "left").select("set_id", "match_id", *counts, F.col("place.row").alias("_r"), F.col("place.line").alias("_l"))
    copy = (F.col("_row") != F.col("_r")) | (F.col("line_no") != F.col("_l"))
    return sets.select("_id", "_row", "line_no", "set_id").join(known_sets, "set_id").select(
        F.col("_id").alias(id_col), "_row", F.col("line_no").cast("bigint").alias("line_no"), F.col("set_id").alias("class_id"), "match_id",
        (copy | F.col("match_id").isNotNull()).alias("removed"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(f"n_{c}") for c in counts),
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the removed lines; a document that loses its last line with words goes if ``drop_emptied``."""
    docs, row, gone = stable(docs), free_name(docs, "_row"), free_name(docs, "_gone")
    lines = similar_lines(docs, id_col=id_col, text_col=text_col, similarity=similarity, links=False)
    found = lines.filter("removed").groupBy(F.col("_row").alias(row)).agg(F.collect_set(F.col("line_no").cast("int")).alias(gone))
    kept = docs.withColumn(row, F.monotonically_increasing_id()).join(found, row, "left")
    text = F.expr(f"array_join(filter(split(`{text_col}`, '\n'), (x, i) -> NOT array_contains({gone}, i)), '\n')")
    out = kept.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text))
    if drop_emptied:
        out = out.filter(F.col(gone).isNull() | F.col(text_col).rlike(r"\S"))
    return out.select(*docs.columns)
