"""Pages of a sorted table without sorting it for each: ranges of rows in order, and how many rows each has.

``lay_out`` sorts once, by range partitioning, and writes every range as a folder of its own with a table of counts. ``page`` adds
up the counts, a row a range, and reads only the ranges that the page's rows are in, one as a rule, however far down it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RANGE = "_range"
#: Ranges at most: the driver samples rows for their bounds, writes each as a task's folder and adds up their counts.
MOST_RANGES = 256
_COUNTS = f"{_RANGE} int, count bigint"


@dataclass(frozen=True)
class Order:
    """A column to sort by; nulls come first if rising, last if falling."""

    column: str
    falling: bool = False

    def expr(self) -> Column:
        return F.col(self.column).desc() if self.falling else F.col(self.column).asc()


def lay_out(rows: DataFrame, folder: str, order: list[Order], rows_per_range: int = 100_000) -> int:
    """Writes the rows in ranges of about so many, or of more if that makes over ``MOST_RANGES``; how many rows there are. The last
    columns of the order should tell all rows apart. The rows are computed once."""
    by = [o.expr() for o in order]
    spark, schema = rows.sparkSession, rows.schema
    rows.write.parquet(f"{folder}/unsorted")
    rows = spark.read.schema(schema).parquet(f"{folder}/unsorted")
    total = rows.count()
    if not total:
        spark.createDataFrame([], _COUNTS).write.parquet(f"{folder}/counts")
        return 0
    n = min(math.ceil(total / rows_per_range), MOST_RANGES)
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(_RANGE, F.spark_partition_id())
    dealt.write.partitionBy(_RANGE).parquet(f"{folder}/rows")
    spark.read.parquet(f"{folder}/rows").groupBy(_RANGE).count().coalesce(1).write.parquet(f"{folder}/counts")
    return total


def page(spark: SparkSession, folder: str, order: list[Order], schema: str, number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows (1 to 500); no rows behind the last one."""
    number, size = max(1, number), min(max(1, size), 500)
    first, before, chosen = (number - 1) * size, 0, []
    skipped = None
    for r in sorted(spark.read.schema(_COUNTS).parquet(f"{folder}/counts").collect()):  # a row a range
        if before < first + size and before + r["count"] > first:
            chosen.append(f"{folder}/rows/{_RANGE}={r[_RANGE]}")
            skipped = before if skipped is None else skipped
        before += r["count"]
    if not chosen:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*chosen)
    return found.orderBy(*(o.expr() for o in order)).offset(first - skipped).limit(size)
