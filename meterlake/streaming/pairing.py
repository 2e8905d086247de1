"""Tool calls whose use and result come in different batches: merged into a table of calls, or paired by a stateful stream.

A call is (source, session, tool use id). Its event is the first result that has a use before it, with the last use before
that; what comes later changes nothing. So any cut of a log into batches gives the same events. A use whose result doesn't
come within some days is given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.times import day, days_before
from ..operators.tools import CALL

USE = ("ts", "project", "tool_name", "est_args_tokens", "head_hashes", "chain_hashes")
RESULT = ("ts", "est_result_tokens", "is_error")
EVENT = (
    "source string, session_id string, tool_use_id string, ts string, project string, tool_name string, est_args_tokens bigint, "
    "head_hashes array<string>, chain_hashes array<string>, est_result_tokens bigint, is_error boolean"
)
_EVENT = [x.split()[0] for x in EVENT.split(", ")]
_KEY = list(CALL)


def seen(uses: DataFrame, results: DataFrame, seq: Column) -> DataFrame:
    """Uses and results as rows (call, seq, use, result), one of the two null; ``seq`` is their order."""
    none = {"head_hashes": F.lit(None).cast("array<string>"), "chain_hashes": F.lit(None).cast("array<string>"), "project": F.lit(None).cast("string")}
    use = F.struct(*(F.col(c) if c in uses.columns else none[c].alias(c) for c in USE))
    result = F.struct(*RESULT)
    return uses.select(*CALL, seq.alias("seq"), use.alias("use")).unionByName(results.select(*CALL, seq.alias("seq"), result.alias("result")), allowMissingColumns=True)


def merge_calls(known: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The table of calls (call, seq and use, result if done) with more rows of ``seen``, all later than what the table has.

    A call of very many rows is no task's burden: each step is an aggregate by call, joined back by equality.
    """
    done = None
    if known is not None:
        done = known.filter("result IS NOT NULL")
        rows = rows.join(done.select(*CALL), _KEY, "left_anti").unionByName(known.filter("result IS NULL"))
    uses = rows.filter("use IS NOT NULL")
    first = uses.groupBy(*CALL).agg(F.min("seq").alias("first"))
    results = rows.filter("result IS NOT NULL").join(first, _KEY).filter("seq > first")
    result = results.groupBy(*CALL).agg(F.min(F.struct("seq", "result")).alias("r"))
    before = uses.join(result, _KEY, "left").filter("r IS NULL OR seq < r.seq")
    # By seq alone, as a use has arrays and nulls.
    merged = before.groupBy(*CALL).agg(F.max("seq").alias("seq"), F.max_by("use", "seq").alias("use"), F.first("r").alias("r"))
    merged = merged.select(*CALL, "seq", "use", F.col("r.result").alias("result"))
    return merged if done is None else done.unionByName(merged)


def tool_events(calls: DataFrame) -> DataFrame:
    """Finished calls; the time is the result's."""
    kept = [c for c in USE if c != "ts"]
    return calls.filter("result IS NOT NULL").select(*CALL, F.col("result.ts").alias("ts"), *(F.col(f"use.{c}").alias(c) for c in kept), "result.est_result_tokens", "result.is_error")


def open_uses(calls: DataFrame, as_of: str | None = None, days: int = 30) -> DataFrame:
    """Uses without a result, of the last ``days`` days."""
    left = calls.filter("result IS NULL").select(*CALL, "use.*")
    return left if as_of is None else left.filter(day(F.col("ts")) >= days_before(as_of, days))


def give_up(calls: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The table without uses that have waited for longer."""
    return calls.filter(F.col("result").isNotNull() | (day(F.col("use.ts")) >= days_before(as_of, days)))


class _Pairing(StatefulProcessor):
    """State of a call: its last use, then only that it is done; both go when the timer says so."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle) -> None:
        self.handle = handle
        self.use = handle.getValueState("use", "ts string, project string, tool_name string, est_args_tokens bigint, head_hashes array<string>, chain_hashes array<string>")
        self.done = handle.getValueState("done", "ts string")

    def _expire(self, ts: str) -> None:
        """A timer at the end of the last day a use may wait; one that is over runs out at the end of this batch."""
        if self.days is None:
            return
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        try:
            begun = datetime.fromisoformat(ts[:10]).replace(tzinfo=UTC).timestamp() * 1000
        except ValueError:
            begun = 0
        self.handle.registerTimer(max(1, int(begun) + (self.days + 1) * 86_400_000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        use = self.use.get() if self.use.exists() else None
        was = use
        for r in sorted(rows, key=lambda r: r.place):
            if r.is_use:
                use = tuple(r[c] for c in USE)
            elif use is not None:
                self.use.clear()
                self.done.update((r.ts,))
                self._expire(r.ts)
                found = dict(zip(USE, use, strict=True)) | {c: r[c] for c in (*CALL, *RESULT)}
                yield Row(**{c: found[c] for c in _EVENT})
                return
        if use is not was:
            self.use.update(use)
            self._expire(use[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.use.clear()
        self.done.clear()
        return iter([])

    def close(self) -> None:
        pass


#: What a session needs for ``pair_stream``. Clocks would have a stream that takes what is there run empty batches for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def pair_stream(rows: DataFrame, days: int | None = 30) -> DataFrame:
    """Tool events of a stream of ``seen`` rows, whose ``seq`` is a number. Calls are forgotten ``days`` days after their last day, by the clock; None keeps them."""
    mine = F.col("use").isNotNull()
    flat = rows.select(
        *CALL, F.col("seq").cast("bigint").alias("place"), mine.alias("is_use"), F.when(mine, F.col("use.ts")).otherwise(F.col("result.ts")).alias("ts"),
        *(F.col(f"use.{c}").alias(c) for c in USE[1:]), *(F.col(f"result.{c}").alias(c) for c in RESULT[1:]),
    )
    return flat.groupBy(*CALL).transformWithState(statefulProcessor=_Pairing(days), outputStructType=EVENT, outputMode="append", timeMode="ProcessingTime")
