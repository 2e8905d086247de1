"""Rollout lines of files that are read in pieces: state is carried over pieces of a file, and from one scan to the next.

``rollouts.usage_events`` runs down a whole file in one window. Here a file comes as runs of lines (``piece``), each a task's
work, and what stands above a run is known by a summary: the last session, model, folder and version, how many segments
were opened, whether the last one may replay another session's history, and its last counted second. Summaries are
combined by a second window over the pieces of a file, a few rows; a run's lines then look up what is above them. Which second a
segment replays, and where it ends, are aggregates by segment, so no segment is one task's burden either.

The summary of all that was read of a file is its ``STATE``: the next scan starts from it and reads only new lines. An open
flagged segment without a replay second holds its last event back; the state has that event, and later lines release or drop it.

The events of all scans together are those of ``rollouts.usage_events`` over the whole file, as long as a segment's seconds
don't go back: an event that was let go stays, though its second should turn out to be the replay's later on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollouts import event_columns

CANDIDATE = (
    "line_no bigint, session_id string, model string, cwd string, agent_version string, ts string, input bigint, cached bigint, output bigint, "
    "reasoning bigint, cumulative bigint"
)
STATE = (
    "file string, segment bigint, session_id string, model string, cwd string, agent_version string, flagged boolean, "
    f"replay string, last_second string, held struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>"
)
_CARRIED = ("session_id", "model", "cwd", "agent_version", "flagged")
_COLUMNS = [x.split()[0] for x in CANDIDATE.split(", ")]
#: Stands before the pieces of a scan, which are numbered from 0.
_BEFORE = -1


def _sources() -> dict[str, Column]:
    meta = F.col("kind") == "session_meta"
    return {
        "session_id": F.col("meta_session"), "model": F.col("model"), "cwd": F.col("cwd"), "agent_version": F.col("version"),
        "flagged": F.when(meta, F.coalesce("replay_suspect", F.lit(False))),
    }


def _above(summaries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """For each piece the last non-null value of each column in the pieces before it, and the segments opened there."""
    w = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.select(
        "file", "piece", F.coalesce(F.sum("opened").over(w), F.lit(0)).alias("up_segment"), *(F.last(c, ignorenulls=True).over(w).alias(f"up_{c}") for c in columns)
    )


def _with_state(records: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the state at each line, and one row a file with the state behind its last line."""
    sources = _sources()
    w = Window.partitionBy("file", "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind") == "session_meta", 1).otherwise(0)
    local = records.select(
        "file", "piece", "line_no", "outcome", "ts", "input", "cached", "output", "reasoning", "cumulative",
        F.sum(opened).over(w).alias("my_segment"), *(F.last(c, ignorenulls=True).over(w).alias(f"my_{name}") for name, c in sources.items()),
    )
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    runs = records.groupBy("file", "piece").agg(F.sum(opened).alias("opened"), *(last(c).alias(name) for name, c in sources.items()))
    known = state.select("file", F.lit(_BEFORE).cast("bigint").alias("piece"), F.col("segment").alias("opened"), *_CARRIED)
    summaries = runs.unionByName(known)
    joined = local.join(_above(summaries, _CARRIED), ["file", "piece"])
    at = joined.select(
        "file", "piece", "line_no", "outcome", "ts", "input", "cached", "output", "reasoning", "cumulative", (F.col("my_segment") + F.col("up_segment")).alias("segment"),
        *(F.coalesce(f"my_{c}", f"up_{c}").alias(c) for c in _CARRIED),
    )
    whole = summaries.groupBy("file").agg(F.sum("opened").alias("segment"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("piece"))).alias(c) for c in _CARRIED))
    return at, whole


def usage_events(records: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage events that the records let go, state of all files after them).

    ``records`` are those of ``rollouts.parse_lines`` with ``piece``, a number from 0 that rises down each file; ``line_no`` only has
    to rise within a file, over all scans (a byte offset will do). ``state`` has the files read before. Both are read several times.
    """
    state = state if state is not None else records.sparkSession.createDataFrame([], STATE)
    rows = records.withColumn("piece", F.col("piece").cast("bigint"))
    at, whole = _with_state(rows, state)
    counted = at.filter((F.col("outcome") == "ok") & F.col("session_id").isNotNull()).select(
        "file", "piece", "segment", F.coalesce("flagged", F.lit(False)).alias("flagged"), "line_no", "session_id", F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("agent_version", F.lit("")).alias("agent_version"), *_COLUMNS[5:],
    )
    held = state.filter("held IS NOT NULL").select("file", F.lit(_BEFORE).cast("bigint").alias("piece"), "segment", F.lit(True).alias("flagged"), "held.*")
    counted = counted.unionByName(held.select(counted.columns)).withColumn("second", F.substring("ts", 1, 19))

    # The counted event before each of a flagged segment: in the same run of lines, else the last one of the runs above.
    mark = F.struct("segment", "second")
    flagged = counted.filter("flagged").withColumn("mark", mark)
    runs = flagged.groupBy("file", "piece").agg(F.max_by("mark", "line_no").alias("mark"), F.lit(0).alias("opened"))
    was = state.filter("held IS NULL AND last_second IS NOT NULL").select(
        "file", F.lit(_BEFORE).cast("bigint").alias("piece"), F.struct("segment", F.col("last_second").alias("second")).alias("mark"), F.lit(0).alias("opened")
    )
    before = _above(runs.unionByName(was), ("mark",)).drop("up_segment")
    w = Window.partitionBy("file", "piece").orderBy("line_no")
    twice = flagged.withColumn("prev", F.lag("mark").over(w)).join(before, ["file", "piece"], "left")
    twice = twice.withColumn("again", F.coalesce(F.coalesce("prev", "up_mark") == F.col("mark"), F.lit(False)))
    found = twice.groupBy("file", "segment").agg(
        F.min_by("second", F.when(F.col("again"), F.col("line_no"))).alias("found"), F.max("line_no").alias("last_line"), F.max_by("second", "line_no").alias("last"),
    )
    known = state.filter("flagged").select("file", "segment", F.col("replay").alias("known"), "last_second")
    segments = found.join(known, ["file", "segment"], "full").select(
        "file", "segment", F.coalesce("known", "found").alias("replay"), "last_line", F.coalesce("last", "last_second").alias("last")
    )

    judged = flagged.join(segments, ["file", "segment"])
    free = F.when(F.col("replay").isNotNull(), F.col("second") != F.col("replay")).otherwise(F.col("line_no") < F.col("last_line"))
    out = counted.filter("NOT flagged").drop("second").unionByName(judged.filter(free).select(*[c for c in counted.columns if c != "second"]))

    # Of the last segment of a file what may still change.
    waits = judged.filter("replay IS NULL AND line_no = last_line").select("file", "segment", F.struct(*_COLUMNS).alias("held"))
    latest = whole.join(segments, ["file", "segment"], "left").join(waits, ["file", "segment"], "left")
    left = latest.select("file", "segment", *_CARRIED, "replay", F.col("last").alias("last_second"), "held")
    return event_columns(out), left


def skipped(records: DataFrame, state: DataFrame | None = None) -> int:
    """Lines that should have counted but can't be read, or have no session above them."""
    state = state if state is not None else records.sparkSession.createDataFrame([], STATE)
    at, _ = _with_state(records.withColumn("piece", F.col("piece").cast("bigint")), state)
    return at.agg(F.count_if((F.col("outcome") == "skip") | ((F.col("outcome") == "ok") & F.col("session_id").isNull()))).first()[0]
