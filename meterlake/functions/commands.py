"""Shell commands as columns: split into chain segments, normalized, hashed. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted span (or its unclosed tail), a lone &, or plain characters; else an operator.
_PIECES = r"""((?:'[^']*(?:'|$)|"[^"]*(?:"|$)|&(?!&)|[^'"&|;\n])+|&&|\|\||\||;|\n)"""
_TOKENS = r"""((?:'[^']*(?:'|$)|"[^"]*(?:"|$)|[^\s'"])+)"""
_QUOTED = r"""'([^']*)(?:'|$)|"([^"]*)(?:"|$)"""
_ASSIGNED = r"^[A-Za-z_][A-Za-z0-9_]*="


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once: inside a lambda Spark shares no common parts of an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_chain(command: Column) -> Column:
    """Segments between &&, ||, ;, | and newlines outside quotes; trimmed, empty ones dropped."""
    pieces = F.regexp_extract_all(command, F.lit(_PIECES), F.lit(1))
    kept = F.filter(pieces, lambda x: ~x.isin("&&", "||", "|", ";", "\n"))
    return F.filter(F.transform(kept, _trim), lambda x: x != "")


def tokenize(segment: Column) -> Column:
    """White-space separated words with their quotes taken off; quoted empty words stay."""
    return F.transform(F.regexp_extract_all(segment, F.lit(_TOKENS), F.lit(1)), lambda x: F.regexp_replace(x, _QUOTED, "$1$2"))


def normalize(segment: Column) -> Column:
    """The words without leading ``rtk`` and NAME=value words, joined by single blanks."""

    def joined(words: Column) -> Column:
        first = F.array_position(F.transform(words, lambda x: (x == "rtk") | x.rlike(_ASSIGNED)), False)
        rest = _once(first, lambda n: F.when(n > 0, F.slice(words, n.cast("int"), F.size(words))))
        return F.when(words.isNotNull(), F.coalesce(F.array_join(rest, " "), F.lit("")))

    return _once(tokenize(segment), joined)


def head(segment: Column) -> Column:
    """Base name of the first word of the normalized segment."""
    return F.substring_index(F.substring_index(normalize(segment), " ", 1), "/", -1)


def command_hash(segment: Column) -> Column:
    return F.sha2(normalize(segment), 256)


def chain_hashes(command: Column) -> Column:
    return F.transform(split_chain(command), command_hash)


def chain_head_hashes(command: Column) -> Column:
    """Hashes of the segments' heads; segments without a head are dropped."""
    return F.transform(F.filter(F.transform(split_chain(command), head), lambda x: x != ""), command_hash)
