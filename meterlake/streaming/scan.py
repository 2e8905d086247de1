"""A scan: what is new in the logs of all agents goes into the ledger, with one commit for all tables and the cursors.

Reads on where the last scan stopped (``sources.slices``), parses transcripts and rollouts, prices events, keeps the highest
version of each, pairs tool calls, and carries the state of rollouts on. Tables of the store:

``usage``        events by (source, message, request)
``cells``        sums of usage (``operators.cube``), which take in what changed, by cell
``calls``        tool calls, open and done, by call
``rollouts``     what later lines of a rollout depend on, by file
``cursors``      how far each file was read, by file

The lines of a scan are written once, as everything is derived from them; the folder goes when the scan ends. A scan that ends
early changes nothing. Of two scans at once the later one wins, the earlier one fails at its commit. Running it again adds
nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.costs import price
from ..functions.identity import project_label
from ..operators import cube
from ..operators.dedup import USAGE_KEY, keep_highest
from ..operators.tools import CALL
from ..sources import carried, rollouts, slices, transcripts
from .pairing import give_up, merge_calls, seen
from .store import Change, Store, Writer


@dataclass(frozen=True)
class Summary:
    """What a scan has done. Of an event read again nothing is inserted."""

    files_scanned: int = 0
    lines_skipped: int = 0
    events_inserted: int = 0
    duplicates_dropped: int = 0
    tool_events_inserted: int = 0
    unknown_models: tuple[str, ...] = ()


def numbered(events: DataFrame, first: int, span: int = slices.RANGE_BYTES) -> DataFrame:
    """Adds ``ingest_seq``: ``first`` and on, by file and place. Numbers are dealt by parts of a file, so a file of any size is
    the work of many tasks; the parts themselves are numbered in one window, a row each."""
    part = F.floor(F.col("line_no") / span)
    rows = events.withColumn("_part", part)
    sizes = rows.groupBy("path", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("path", "_part")) - F.col("_n")).drop("_n")
    at = F.row_number().over(Window.partitionBy("path", "_part").orderBy("line_no"))
    return rows.join(before, ["path", "_part"]).withColumn("ingest_seq", (F.col("_before") + at - 1 + F.lit(first)).cast("bigint")).drop("_before", "_part")


def merge_usage(known: DataFrame | None, events: DataFrame) -> DataFrame:
    """Events of the table and new ones (with ``ingest_seq`` above all ``id`` of the table): keys keep their highest version."""
    if known is None:
        return keep_highest(events)
    was = known.select(*USAGE_KEY, F.col("dirty").alias("_dirty"))
    kept = keep_highest(known.drop("dirty").withColumn("ingest_seq", F.col("id")).drop("id").unionByName(events, allowMissingColumns=True))
    joined = kept.join(was, list(USAGE_KEY), "left")
    return joined.withColumn("dirty", F.col("dirty") | F.coalesce("_dirty", F.lit(False))).drop("_dirty").select(known.columns)


def _replace(known: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    return rows if known is None else known.join(rows.select(key), key, "left_anti").unionByName(rows)


def _rows(change: Change, name: str, touched: list[int], before: bool, done: bool = False) -> int:
    """Rows (of calls: done ones) in the touched buckets of a table, before the change or after."""
    table = change.writer.store.read(name, at=change.base, buckets=touched) if before else change.read(name, touched)
    return 0 if table is None else (table.filter("result IS NOT NULL") if done else table).count()


def scan(
    spark: SparkSession, writer: Writer, *, transcript_roots: list[str] = (), rollout_roots: list[str] = (), as_of: str, machine: tuple[str, str] = ("local", "local"),
    range_bytes: int = slices.RANGE_BYTES, buckets: int = 64,
) -> Summary:
    """One scan of the roots, up to its commit."""
    store = writer.store
    change = writer.start()
    number = change.base.number + 1
    scratch = f"{store.folder}/scratch-{uuid.uuid4().hex}"
    write = lambda df, name: (df.write.parquet(f"{scratch}/{name}"), spark.read.schema(df.schema).parquet(f"{scratch}/{name}"))[1]
    try:
        listed = slices.listing(spark, [*transcript_roots, *rollout_roots])
        planned = write(slices.plan(listed, store.read("cursors", at=change.base)), "plan")
        files = planned.count()
        if not files:
            return Summary()
        lines = write(slices.read_ranges(slices.ranges(planned, range_bytes)), "lines")
        below = lambda roots: lines.join(planned.filter(F.col("root").isin(list(roots))).select("path"), "path", "left_semi")
        talk, rolled = below(transcript_roots), below(rollout_roots)

        found = transcripts.usage_events(talk)
        records = write(rollouts.parse_lines(rolled).withColumn("piece", F.floor(F.col("line_no") / range_bytes)), "records")
        again = planned.filter("start > 0").select(F.col("path").alias("file"))  # of files read from their start nothing is carried
        known = store.read("rollouts", at=change.base)
        known = known.join(again, "file", "left_semi") if known is not None else None
        counted, state = carried.usage_events(records, known)
        both = found.filter("outcome = 'event'").drop("outcome").unionByName(counted.withColumnRenamed("file", "path"))
        id_, name = machine
        priced = price(both).withColumns({"project_label": project_label(F.col("project")), "machine_id": F.lit(id_), "machine_name": F.lit(name)})
        events = write(priced, "events")
        n, first = events.count(), int(change.state.get("next_id", 0))
        touched = change.upsert("usage", numbered(events, first, range_bytes).drop("path", "line_no"), USAGE_KEY, merge_usage, buckets=buckets)
        inserted = _rows(change, "usage", touched, before=False) - _rows(change, "usage", touched, before=True)
        change.state["next_id"] = first + n
        if touched:
            changed = cube.delta(store.read("usage", at=change.base, buckets=touched), change.read("usage", touched))
            change.upsert("cells", write(changed, "cells"), cube.CELL, cube.add, buckets=buckets)

        seq = F.struct(F.lit(number).cast("bigint").alias("scan"), "path", "line_no", "block_no")
        rows = write(seen(transcripts.tool_uses(talk), transcripts.tool_results(talk), seq), "calls")
        touched = change.upsert("calls", rows, CALL, lambda old, new: give_up(merge_calls(old, new), as_of), buckets=buckets)
        paired = _rows(change, "calls", touched, before=False, done=True) - _rows(change, "calls", touched, before=True, done=True)
        # A file read from its start has its own state again, one without lines none.
        mine = rolled.select(F.col("path").alias("file")).distinct()
        for name, left, key in (("rollouts", state.join(mine, "file", "left_semi"), "file"), ("cursors", slices.cursors_after(planned, lines), "path")):
            change.upsert(name, write(left, name), (key,), lambda old, new, key=key: _replace(old, new, key), buckets=buckets)
        skipped = found.agg(F.count_if(F.col("outcome") == "skip")).first()[0] + carried.skipped(records, known)
        unknown = tuple(r[0] for r in events.filter("cost_usd IS NULL").select("model").distinct().orderBy("model").limit(1000).collect())
        change.commit()
        return Summary(files, skipped, inserted, n - inserted, paired, unknown)
    finally:
        store.files.delete(spark._jvm.org.apache.hadoop.fs.Path(scratch), True)


def open_store(spark: SparkSession, folder: str) -> Writer:
    return Store(spark, folder).writer()
