"""Typed reads from a VARIANT column: what a field is decides what it counts as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """The JSON value, or null if the text isn't JSON."""
    return F.try_parse_json(text)


def field(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "variant")


def kind(v: str, path: str) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID, OBJECT or ARRAY; null if there is no such field."""
    return F.regexp_extract(F.schema_of_variant(field(v, path)), r"^[A-Z]+", 0)


def text(v: str, path: str) -> Column:
    """The field if it is a string, else an empty one."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(F.col(v), path, "string")).otherwise("")


def number(v: str, path: str) -> Column:
    """The field if it is a number, as a double."""
    return F.when(kind(v, path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(F.col(v), path, "double"))


def tokens(v: str, path: str) -> Column:
    """Missing or null is 0, fractions are cut off, anything but a number is null (the record is to be rejected)."""
    k = kind(v, path)
    whole = F.when(k == "BIGINT", F.try_variant_get(F.col(v), path, "bigint")).otherwise(number(v, path).try_cast("bigint"))
    return F.when(k.isNull() | (k == "VOID"), F.lit(0).cast("bigint")).otherwise(whole)


def whole(v: str, path: str) -> Column:
    """The field if it is a whole number, else 0."""
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(F.col(v), path, "bigint")).otherwise(F.lit(0).cast("bigint"))


def elements(v: str, path: str) -> Column:
    """The elements of an array field; null if it isn't one."""
    return F.when(kind(v, path) == "ARRAY", F.try_variant_get(F.col(v), path, "array<variant>"))


def json_bytes(v: str, path: str) -> Column:
    """Bytes of the field as compact JSON; null if there is no such field."""
    return F.octet_length(F.to_json(field(v, path)))
