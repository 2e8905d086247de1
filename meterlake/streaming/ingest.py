"""Transcripts followed by micro-batches into the ``usage`` table of a store; a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import USAGE_KEY
from ..sources.lines import AgentLines
from ..sources.transcripts import usage_events
from .scan import merge_usage, numbered
from .store import Store

#: Lines of the stream are numbered in their file; so many are one part of it.
_PART = 1 << 20


def ingest_transcripts(spark: SparkSession, roots: str, folder: str, checkpoint: str, *, every: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Follows transcript files below the roots. Without ``every`` it takes what is there and ends. A batch rewrites the buckets of
    ``usage`` that its events touch; its number is part of the commit."""
    spark.dataSource.register(AgentLines)
    writer = Store(spark, folder).writer()

    def step(batch: DataFrame, batch_id: int) -> None:
        change = writer.start()
        if change.state.get("batch", -1) >= batch_id:
            return
        first = int(change.state.get("next_id", 0))
        found = usage_events(batch).filter("outcome = 'event'").drop("outcome").persist()
        try:
            change.upsert("usage", numbered(found, first, _PART).drop("path", "line_no"), USAGE_KEY, merge_usage, buckets=buckets)
            change.state |= {"batch": batch_id, "next_id": first + found.count()}
            change.commit()
        finally:
            found.unpersist()

    stream = spark.readStream.format("agent_lines").option("path", roots).load().writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def total_of(usage: DataFrame) -> int:
    from ..plans.schema import total_tokens

    return usage.agg(F.coalesce(F.sum(total_tokens()), F.lit(0))).first()[0]
