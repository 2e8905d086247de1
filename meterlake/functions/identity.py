"""Names and ids: project labels, hashes of parts, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_from_cwd(cwd: Column) -> Column:
    """The path without trailing slashes, unless that empties it."""
    cut = F.regexp_replace(cwd, "/+$", "")
    return F.when(cut == "", cwd).otherwise(cut)


def project_label(path: Column) -> Column:
    """Last part of a path over slashes of both kinds; a path of separators only stays."""
    last = F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"[^/\\]*$", 0)
    return F.when(last == "", path).otherwise(last)


def hash_parts(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; the parts are not null."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def clamp(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def agent_name(source: Column) -> Column:
    return F.replace(source, F.lit("_"), F.lit("-"))
