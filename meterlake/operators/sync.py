"""What is exchanged with a server: whitelisted records out, records of other machines in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import micro_usd
from ..functions.identity import agent_name, clamp, hash_parts, project_label

#: Most characters of a model, project label and machine name; most tokens and micro-dollars of a record.
MAX_MODEL, MAX_LABEL, MAX_MACHINE, MAX_TOKENS, MAX_COST = 100, 120, 64, 100_000_000, 10_000_000_000


def with_prefs(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """Adds a project's preferences (``synced_label``, ``excluded``) by its label, or its path if it has none."""
    own = prefs.select(F.col("name").alias("_name"), "synced_label", "excluded")
    joined = events.join(own, F.coalesce("project_label", "project") == F.col("_name"), "left").drop("_name")
    return joined.withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def to_push(events: DataFrame, cursor: int) -> DataFrame:
    """New events, and old ones that grew since."""
    return events.filter((F.col("id") > cursor) | F.col("dirty"))


def next_batch(events: DataFrame, cursor: int, n: int = 1000) -> DataFrame:
    return to_push(events, cursor).orderBy("id").limit(n)


def pending_count(events: DataFrame, prefs: DataFrame, cursor: int) -> DataFrame:
    """New events of projects that aren't excluded; grown old ones don't count here."""
    return with_prefs(events.filter(F.col("id") > cursor), prefs).filter(~F.col("excluded")).agg(F.count("*").alias("pending"))


def records(events: DataFrame, prefs: DataFrame, machine_id: str = "", machine_name: str = "") -> DataFrame:
    """The fields that leave the machine, for events of projects that aren't excluded."""
    rows = with_prefs(events, prefs).filter(~F.col("excluded"))
    tokens = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(MAX_TOKENS)).cast("bigint")
    output, label = tokens(F.col("output_tokens")), F.coalesce("synced_label", "project_label", project_label(F.col("project")))
    cost = F.when(F.col("cost_usd") > 0, F.least(micro_usd(F.col("cost_usd")), F.lit(MAX_COST))).otherwise(0)
    return rows.select(
        "id", hash_parts(F.col("source"), F.col("message_id"), F.col("request_id")).alias("event_id"), "ts", agent_name(F.col("source")).alias("agent"),
        clamp(F.col("model"), MAX_MODEL).alias("model"), clamp(label, MAX_LABEL).alias("project_label"), hash_parts(F.col("session_id")).alias("session_id"),
        F.coalesce("machine_id", F.lit(machine_id)).alias("machine_id"), clamp(F.coalesce("machine_name", F.lit(machine_name)), MAX_MACHINE).alias("machine_name"),
        tokens(F.col("input_tokens")).alias("input_tokens"), output.alias("output_tokens"), tokens(F.col("cache_read_tokens")).alias("cache_read_tokens"),
        tokens(F.col("cache_creation_tokens")).alias("cache_creation_tokens"), F.least(tokens(F.col("reasoning_tokens")), output).alias("reasoning_tokens"),
        cost.cast("bigint").alias("est_cost_microusd"), "cost_basis",
    )


def preview(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """The record of the earliest event, excluded or not."""
    return records(events.orderBy("id").limit(1), prefs.withColumn("excluded", F.lit(False))).limit(1)


def machines(merged: DataFrame, current: str) -> DataFrame:
    """Each machine's last time, name at that time (of several the last by name), number of events, and whether it is this one."""
    sums = merged.groupBy("machine_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("event_count"), F.max(F.struct("ts", "machine_name"))["machine_name"].alias("machine_name"))
    return sums.withColumn("is_current", F.col("machine_id") == current).orderBy(F.desc("event_count"), "machine_id")


def labels(events: DataFrame) -> DataFrame:
    return events.select(F.coalesce("project_label", "project").alias("name")).distinct().orderBy("name")


def review(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """Every label with its preferences, if it has any."""
    own = prefs.select("name", "synced_label", "excluded")
    return labels(events).join(own, "name", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False))).orderBy("name")


def advance(old: Column, new: Column) -> Column:
    """A watermark never goes back."""
    return F.greatest(old, new)


def push(rows: DataFrame, send: Callable[[list[dict]], object], size: int = 1000) -> int:
    """Sends records in id order, in batches; stops if ``send`` returns False (quota). How many were sent."""
    batch, sent = [], 0

    def flush() -> bool:
        nonlocal batch, sent
        if batch and send(batch) is False:
            return False
        sent, batch = sent + len(batch), []
        return True

    for r in rows.orderBy("id").toLocalIterator():
        batch.append(r.asDict())
        if len(batch) == size and not flush():
            return sent
    flush()
    return sent


def pull(spark, pages: Callable[[int], Iterable[dict]], cursor: int, schema: str) -> DataFrame:
    """All records after a cursor, page by page until one is empty."""
    rows: list[dict] = []
    while page := list(pages(cursor)):
        rows += page
        cursor = max(r["server_seq"] for r in page)
    return spark.createDataFrame(rows, schema)
