"""The dashboard's queries over local and pulled events together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import micro_usd
from ..functions.display import billing_label, billing_mode
from ..functions.identity import agent_name, project_label
from ..functions.times import day, days_before, epoch, rfc3339, to_epoch
from ..plans.schema import MERGED, TOKENS, total_tokens


@dataclass(frozen=True)
class Filter:
    """What the dashboard can narrow to; ``agent`` in the ledger's form, with underscores."""

    project: str | None = None
    machine: str | None = None
    agent: str | None = None
    first: str | None = None
    last: str | None = None

    @staticmethod
    def of(params: dict[str, str | None]) -> Filter:
        """From request parameters: blanks are trimmed, empty ones are absent, hyphens in the agent are folded."""
        tidy = {k: (v or "").strip() or None for k, v in params.items()}
        agent = tidy.get("agent")
        return Filter(tidy.get("project"), tidy.get("machine"), agent and agent.replace("-", "_"), tidy.get("from"), tidy.get("to"))

    def apply(self, merged: DataFrame) -> DataFrame:
        for col, value in (("project_label", self.project), ("machine_id", self.machine), ("source", self.agent)):
            merged = merged if value is None else merged.filter(F.col(col) == value)
        return self.days(merged)

    def days(self, df: DataFrame) -> DataFrame:
        df = df if self.first is None else df.filter(day(F.col("ts")) >= self.first)
        return df if self.last is None else df.filter(day(F.col("ts")) <= self.last)


def merged_events(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local events with costs in micro-dollars, and pulled ones."""
    own = local.withColumns(
        {
            "est_cost_microusd": micro_usd(F.col("cost_usd")), "unpriced": F.col("cost_usd").isNull().cast("bigint"),
            "project_label": F.coalesce("project_label", project_label(F.col("project"))),
        }
    )
    pulled = remote.withColumns({"source": F.replace(F.col("agent"), F.lit("-"), F.lit("_")), "unpriced": F.lit(0).cast("bigint")})
    return own.select(*MERGED).unionByName(pulled.select(*MERGED))


def _sum(col: Column | str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _positive(col: Column) -> Column:
    return F.greatest(col, F.lit(0)).cast("bigint")


def _share(total: str) -> Column:
    grand = F.sum(total).over(Window.partitionBy())
    return F.when(grand > 0, F.col(total) / grand).otherwise(0.0)


def _basis() -> tuple[Column, Column]:
    return F.col("cost_basis") == "estimated", F.col("cost_basis").isin("logged", "billed")


def mode_counts(merged: DataFrame) -> DataFrame:
    sub, api = _basis()
    return merged.agg(F.count_if(sub).alias("subscription_events"), F.count_if(api).alias("api_events"))


def summary(merged: DataFrame, f: Filter, as_of: str, override: str | None = None) -> DataFrame:
    sub, api = _basis()
    today, cost, total = day(F.col("ts")) == as_of[:10], F.col("est_cost_microusd"), total_tokens()
    one = f.apply(merged).agg(
        _sum(total).alias("total"), _sum("cache_read_tokens").alias("cache_read"), _sum(F.when(sub, cost)).alias("sub_cost"),
        _sum(F.when(api, cost)).alias("api_cost"), F.count_if(sub).alias("sub_events"), F.count_if(api).alias("api_events"),
        F.count_distinct("project_label").alias("project_count"), F.count_distinct("machine_id").alias("machine_count"),
        F.min(day(F.col("ts"))).alias("since"), _sum(F.when(today, total)).alias("today_tokens"), _sum(F.when(today, cost)).alias("today_cost"),
    )
    mode = billing_mode(F.col("sub_events"), F.col("api_events"), override)
    return one.select(
        _positive(F.col("total")).alias("total_tokens"), _positive(F.col("sub_cost") + F.col("api_cost")).alias("est_cost_microusd"),
        billing_label(mode).alias("cost_label"), mode.alias("billing_mode"), (mode != "api").alias("plan_window_applicable"),
        _positive(F.col("today_tokens")).alias("today_tokens"), _positive(F.col("today_cost")).alias("today_est_cost_microusd"),
        F.when(F.col("total") > 0, F.col("cache_read") / F.col("total")).otherwise(0.0).alias("cache_read_ratio"),
        "project_count", "machine_count", "since", _positive(F.col("sub_cost")).alias("subscription_microusd"), _positive(F.col("api_cost")).alias("api_microusd"),
    )


def mode_breakdown(merged: DataFrame, f: Filter, as_of: str, override: str | None = None) -> DataFrame:
    """One row a billing mode of the selection: two if it is mixed."""
    s = summary(merged, f, as_of, override)
    row = lambda mode, cost: F.struct(F.lit(mode).alias("billing_mode") if isinstance(mode, str) else mode.alias("billing_mode"), cost.alias("est_cost_microusd"))
    both = F.array(row("subscription", F.col("subscription_microusd")), row("api", F.col("api_microusd")))
    rows = F.when(F.col("billing_mode") == "mixed", both).otherwise(F.array(row(F.col("billing_mode"), F.col("est_cost_microusd"))))
    modes = s.select(F.explode(rows).alias("m")).select("m.*")
    return modes.withColumn("cost_label", billing_label(F.col("billing_mode")))


def _usage_rows(merged: DataFrame, f: Filter, key: Column, name: str) -> DataFrame:
    sums = f.apply(merged).groupBy(key.alias(name)).agg(
        *(_sum(c).alias(c) for c in TOKENS), _sum(total_tokens()).alias("total_tokens"), _sum("est_cost_microusd").alias("est_cost_microusd"),
        _sum("unpriced").alias("unpriced_events"),
    )
    shared = sums.withColumn("share", _share("total_tokens"))
    out = shared.withColumns({c: _positive(F.col(c)) for c in (*TOKENS, "total_tokens", "est_cost_microusd", "unpriced_events")})
    return out.orderBy(F.desc("total_tokens"), name)


def by_model(merged: DataFrame, f: Filter) -> DataFrame:
    return _usage_rows(merged, f, F.col("model"), "model")


def by_agent(merged: DataFrame, f: Filter) -> DataFrame:
    return _usage_rows(merged, f, agent_name(F.col("source")), "agent")


def by_project(merged: DataFrame, f: Filter) -> DataFrame:
    sums = f.apply(merged).groupBy("project_label").agg(
        _sum(total_tokens()).alias("total_tokens"), _sum("est_cost_microusd").alias("est_cost_microusd"), F.count_distinct("session_id").alias("session_count")
    ).withColumn("share", _share("total_tokens"))
    return sums.withColumns({c: _positive(F.col(c)) for c in ("total_tokens", "est_cost_microusd")}).orderBy(F.desc("total_tokens"), "project_label")


def daily_models(merged: DataFrame, f: Filter) -> DataFrame:
    """Flat form of the daily series: one row a day and model."""
    sums = f.apply(merged).groupBy(day(F.col("ts")).alias("date"), "model").agg(
        *(_positive(_sum(c)).alias(c) for c in TOKENS), _positive(_sum(total_tokens())).alias("total_tokens"),
        _positive(_sum("est_cost_microusd")).alias("est_cost_microusd"),
    )
    return sums.orderBy("date", F.desc("total_tokens"), "model")


def daily(merged: DataFrame, f: Filter) -> DataFrame:
    """One row a day; ``by_model`` is ordered by tokens, falling."""
    flat = daily_models(merged, f)
    row = F.struct((-F.col("total_tokens")).alias("_order"), "model", *TOKENS, "total_tokens", "est_cost_microusd")
    nested = flat.groupBy("date").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("est_cost_microusd").alias("est_cost_microusd"), F.sort_array(F.collect_list(row)).alias("by_model")
    )
    return nested.withColumn("by_model", F.transform("by_model", lambda x: x.dropFields("_order"))).orderBy("date")


def heatmap(merged: DataFrame, f: Filter, as_of: str) -> DataFrame:
    """Days of the last 52 weeks with their level 0 to 4 against the busiest, and the busiest day's tokens."""
    sums = f.apply(merged).filter(day(F.col("ts")) >= days_before(as_of, 364)).groupBy(day(F.col("ts")).alias("date")).agg(
        _sum(total_tokens()).alias("total_tokens"), _sum("est_cost_microusd").alias("est_cost_microusd")
    )
    most, t = F.max("total_tokens").over(Window.partitionBy()), F.col("total_tokens")
    level = F.when((t <= 0) | (most <= 0), 0).when(t * 4 >= most * 3, 4).when(t * 2 >= most, 3).when(t * 4 >= most, 2).otherwise(1)
    out = sums.withColumns({"level": level, "max_tokens": _positive(most), "horizon": F.lit(days_before(as_of, 30))})
    return out.withColumns({c: _positive(F.col(c)) for c in ("total_tokens", "est_cost_microusd")}).orderBy("date")


def calendar(cells: DataFrame, as_of: str, weeks: int = 53) -> DataFrame:
    """The heat map's grid: every day of the last weeks up to the Saturday of the latest, with column and weekday (Sunday 0)."""
    last = F.lit(as_of[:10]).cast("date")
    first = F.date_sub(F.date_sub(last, F.dayofweek(last) - 1), 7 * (weeks - 1))
    days = cells.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("d"), first.alias("f"))
    grid = days.select(
        F.date_format("d", "yyyy-MM-dd").alias("date"), F.floor(F.datediff("d", "f") / 7).cast("int").alias("col"), (F.dayofweek("d") - 1).alias("row")
    )
    joined = grid.join(cells.select("date", "total_tokens", "level"), "date", "left")
    return joined.withColumns({"total_tokens": F.coalesce("total_tokens", F.lit(0)), "level": F.coalesce("level", F.lit(0))}).orderBy("date")


def sessions(merged: DataFrame, savings: DataFrame, f: Filter) -> DataFrame:
    """One row a session, the latest first."""
    sums = f.apply(merged).groupBy("session_id").agg(
        F.max("project_label").alias("project_label"), F.max("machine_name").alias("machine_name"), F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"), F.count("*").alias("event_count"), _positive(_sum(total_tokens())).alias("total_tokens"),
        _positive(_sum("est_cost_microusd")).alias("est_cost_microusd"),
        F.when(F.count_distinct("model") > 1, "mixed").otherwise(F.max("model")).alias("model"), agent_name(F.max("source")).alias("agent"),
    )
    saved = savings.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.sum("saved_tokens").alias("rtk_saved_tokens"))
    return sums.join(saved, "session_id", "left").orderBy(F.desc("started_at"), "session_id")


def session_page(merged: DataFrame, savings: DataFrame, f: Filter, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of sessions (from 1, of 1 to 500 rows), and the one-row number of all sessions."""
    page, page_size = max(1, page), min(max(1, page_size), 500)
    every = sessions(merged, savings, f)
    return every.offset((page - 1) * page_size).limit(page_size), f.apply(merged).agg(F.count_distinct("session_id").alias("total"))


SPANS = (("rolling_5h", 5 * 3600), ("weekly", 7 * 86400))


def plan_windows(merged: DataFrame, f: Filter, as_of: str, *, limits: tuple[int, int] = (0, 0), override: str | None = None) -> DataFrame:
    """Tokens of one agent's subscription in the trailing 5 hours and 7 days, both ends included: no row if all use is
    metered. The billing mode looks at all agents; the tokens are of ``claude_code`` alone, and only estimated ones
    unless subscription is set by the user."""
    now, f = to_epoch(as_of), replace(f, agent=None)
    counts = mode_counts(f.apply(merged))
    mode = billing_mode(F.col("subscription_events"), F.col("api_events"), override)
    mine = f.apply(merged).filter((F.col("source") == "claude_code") & (day(F.col("ts")) >= days_before(as_of, 8)))
    mine = mine if override == "subscription" else mine.filter("cost_basis = 'estimated'")
    e, rows = epoch(F.col("ts")), []
    for (name, span), limit in zip(SPANS, limits, strict=True):
        inside = (e >= now - span) & (e <= now)
        used = mine.agg(_sum(F.when(inside, total_tokens())).alias("used"), F.coalesce(F.min(F.when(inside, e)), F.lit(now)).alias("oldest"))
        rows.append(
            used.select(
                F.lit(name).alias("window"), F.lit(span // 3600).alias("window_hours"), _positive(F.col("used")).alias("tokens_used"),
                F.lit(limit).cast("bigint").alias("limit_tokens"), F.lit(0.0).alias("utilization") if limit <= 0 else (F.col("used") / limit).alias("utilization"),
                rfc3339(F.col("oldest") + span).alias("resets_at"),
            )
        )
    applies = counts.filter(mode != "api").select(F.lit(True).alias("applicable"))
    return rows[0].unionByName(rows[1]).join(applies)  # a row or none


def rolling_usage(events: DataFrame, span_s: int) -> DataFrame:
    """Each event with the tokens of its session's source in the span up to it, both ends included.

    A running sum within buckets of the span's length: tokens come in at their second, are carried into the next bucket at
    its start and go out of it a second after their span. A bucket has at most two rows a second of its span, whatever the
    rate of events; tokens are added up by second before the shuffle.
    """
    timed = events.withColumn("ts_epoch", epoch(F.col("ts"))).filter("ts_epoch IS NOT NULL")
    bucket, used, e = F.floor(F.col("ts_epoch") / span_s), F.col("used"), F.col("ts_epoch")
    seconds = timed.groupBy("source", "ts_epoch").agg(F.sum(total_tokens()).alias("used"))
    step = lambda b, at, n, own: F.struct(b.alias("b"), at.alias("at"), n.alias("n"), F.lit(own).alias("own"))
    after = bucket + 1
    steps = seconds.select("source", F.inline(F.array(step(bucket, e, used, True), step(after, after * span_s, used, False), step(after, e + span_s + 1, -used, False))))
    steps = steps.groupBy("source", "b", "at").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    total = F.sum("n").over(Window.partitionBy("source", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rolling = steps.withColumn("rolling_tokens", total).filter("own").select(F.col("source").alias("_source"), F.col("at").alias("_at"), "rolling_tokens")
    return timed.join(rolling, F.col("source").eqNullSafe(F.col("_source")) & (e == F.col("_at"))).drop("_source", "_at")


def savings_window(merged: DataFrame, savings: DataFrame, f: Filter) -> DataFrame:
    """Consumed and saved tokens of the selection. Attributed rows count if their session is in it; others only if nothing
    but days is selected. All zero and null if there are no savings rows at all."""
    chosen = f.apply(merged)
    consumed = chosen.agg(_sum(total_tokens()).alias("consumed"))
    timed = f.days(savings)
    scoped = f.project is not None or f.machine is not None or f.agent is not None
    matched = timed.filter("match_kind <> 'none'").join(chosen.select("session_id").distinct(), "session_id", "left_semi")
    saved = matched.agg(_sum("saved_tokens").alias("saved"), F.count("*").alias("n"))
    other = timed.filter("match_kind = 'none'").agg(_sum("saved_tokens").alias("other"))
    present = savings.limit(1).agg((F.count("*") > 0).alias("rtk_present"))
    one = consumed.join(saved).join(other).join(present)  # one row each
    there, null = F.col("rtk_present"), F.lit(None).cast("bigint")
    return one.select(
        F.when(there, _positive(F.col("consumed"))).otherwise(0).cast("bigint").alias("consumed_tokens"),
        F.when(there, _positive(F.col("saved"))).otherwise(0).cast("bigint").alias("saved_attributed"),
        (null if scoped else F.when(there, _positive(F.col("other")))).alias("saved_unattributed"),
        F.when(there, F.col("n")).otherwise(0).cast("bigint").alias("commands"),
        F.when(there & (F.col("consumed") > 0), F.col("saved") / F.col("consumed")).alias("savings_ratio"), "rtk_present",
    )


def savings_daily(merged: DataFrame, savings: DataFrame, f: Filter) -> DataFrame:
    """Consumed and attributed saved tokens by day; days with either."""
    chosen = f.apply(merged)
    consumed = chosen.groupBy(day(F.col("ts")).alias("date")).agg(_sum(total_tokens()).alias("c"))
    matched = f.days(savings).filter("match_kind <> 'none'").join(chosen.select("session_id").distinct(), "session_id", "left_semi")
    saved = matched.groupBy(day(F.col("ts")).alias("date")).agg(_sum("saved_tokens").alias("s"))
    both = consumed.join(saved, "date", "full_outer")
    return both.select("date", _positive(F.coalesce("c", F.lit(0))).alias("consumed"), _positive(F.coalesce("s", F.lit(0))).alias("saved")).orderBy("date")


def model_order(merged: DataFrame) -> DataFrame:
    """Models by all their tokens, falling."""
    return merged.groupBy("model").agg(_sum(total_tokens()).alias("total_tokens")).orderBy(F.desc("total_tokens"), "model")


def token_kinds_daily(merged: DataFrame) -> DataFrame:
    """Tokens of each kind and all of them by day."""
    return merged.groupBy(day(F.col("ts")).alias("date")).agg(*(_sum(c).alias(c) for c in TOKENS), _sum(total_tokens()).alias("total_tokens")).orderBy("date")


def relative_shares(rows: DataFrame, share: str = "share") -> DataFrame:
    """Bar widths: each share relative to the largest."""
    most = F.max(share).over(Window.partitionBy())
    return rows.withColumn("width", F.when(most > 0, F.col(share) / most).otherwise(0.0))
