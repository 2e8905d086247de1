"""Foreign SQLite tables as DataFrames: a Python data source that reads ranges of a key in parallel, read-only.

Every value comes with what it is stored as, because columns of these files are loosely typed: a field is a struct
(kind, text, whole, real) with kind one of integer, real, text, blob, null. Columns a file doesn't have are absent.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VALUE = "struct<kind:string,text:string,whole:bigint,real:double>"
_KINDS = {int: "integer", float: "real", str: "text", bytes: "blob", type(None): "null"}


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def table_columns(path: str, table: str) -> list[str]:
    """Names of a table's columns; none if there is no such table."""
    with connect(path) as db:
        return [r[1] for r in db.execute("SELECT * FROM pragma_table_info(?)", (table,))]


def table_stats(path: str, table: str, order: str) -> tuple[int, object, object]:
    """(rows, largest order value, smallest id): what tells whether a database was replaced."""
    with connect(path) as db:
        return db.execute(f'SELECT count(*), max("{order}"), min(id) FROM "{table}"').fetchone()


def _value(x: object) -> tuple:
    kind = _KINDS[type(x)]
    number = x if kind in ("integer", "real") else None
    return (kind, x if kind == "text" else None, x if kind == "integer" else None, None if number is None else float(number))


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.where, self.step = options.get("where", "1"), int(options.get("rowsperpartition", 100_000))
        self.columns = table_columns(self.path, self.table)

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [_Rows(0, 0)] if low is None else [_Rows(a, min(a + self.step, high + 1)) for a in range(low, high + 1, self.step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        with connect(self.path) as db:
            names = ", ".join(f'"{c}"' for c in self.columns)
            for row in db.execute(f'SELECT rowid, {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? AND ({self.where})', (part.low, part.high)):
                yield (row[0], *map(_value, row[1:]))


class SqliteTable(DataSource):
    """Format ``sqlite_table``; options path, table, where (a condition in SQLite's SQL), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return "_rowid bigint, " + ", ".join(f"`{c}` {VALUE}" for c in table_columns(self.options["path"], self.options["table"]))

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_table(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, **options).load()


def text(df: DataFrame, name: str) -> Column:
    """The column where it holds text; null elsewhere and if there is no such column."""
    return F.col(f"{name}.text") if name in df.columns else F.lit(None).cast("string")


def whole(df: DataFrame, name: str) -> Column:
    return F.col(f"{name}.whole") if name in df.columns else F.lit(None).cast("bigint")


def real(df: DataFrame, name: str) -> Column:
    """The column where it holds a number."""
    return F.col(f"{name}.real") if name in df.columns else F.lit(None).cast("double")


def counter(df: DataFrame, name: str) -> Column:
    """A token counter: fractions cut off, negative, absent and other values 0."""
    cut = F.coalesce(whole(df, name), real(df, name).try_cast("bigint"), F.lit(0))
    return F.greatest(cut, F.lit(0)).cast("bigint")
