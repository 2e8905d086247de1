"""Numbers as people read them, and billing modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBSCRIPTION_LABEL = "API-equivalent value"
API_LABEL = "estimated spend"


def tokens_text(n: Column) -> Column:
    """950 -> 950, 1500 -> 1.5K, 2000000 -> 2M; a unit starts where the lower one would round to 1000."""
    size = F.abs(n)

    def scaled(by: float, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", n / F.lit(by)), r"\.0$", ""), F.lit(unit))

    return (
        F.when(size < 1_000, n.cast("string")).when(size < 999_950, scaled(1e3, "K"))
        .when(size < 999_950_000, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))
    )


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def cost_text(cost: Column) -> Column:
    """$1,456.84; <$0.01 for less than half a cent; n/a if there is none."""
    bad = cost.isNull() | F.isnan(cost) | (F.abs(cost) == float("inf"))
    sign = F.when(cost < 0, "-").otherwise("")
    return (
        F.when(bad, "n/a").when((cost > 0) & (cost < 0.005), "<$0.01")
        .otherwise(F.concat(sign, F.lit("$"), F.format_number(F.abs(cost), 2)))
    )


def noun_text(n: Column, noun: str) -> Column:
    return F.concat(count_text(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def _fixed(n: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", n.cast("double"))


def short_tokens_text(n: Column) -> Column:
    """As the dashboard writes counts: 1500 -> 1.5K, 123456 -> 123K, 1000000 -> 1M; no unit below 1000."""

    def scaled(by: float, unit: str) -> Column:
        x = n / F.lit(by)
        return F.concat(F.when(x >= 100, _fixed(x, 0)).otherwise(F.regexp_replace(_fixed(x, 1), r"\.0$", "")), F.lit(unit))

    size = F.abs(n)
    return F.when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(n.cast("string"))


def micro_cost_text(micro_usd: Column) -> Column:
    """Micro-dollars: $0.42 below 10 dollars, $42 below 1000, then as counts are ($1.5K)."""
    usd = micro_usd / F.lit(1e6)
    size = F.abs(usd)
    return F.concat(F.lit("$"), F.when(size >= 1000, short_tokens_text(usd)).when(size >= 10, _fixed(usd, 0)).otherwise(_fixed(usd, 2)))


def percent_text(fraction: Column, digits: int = 0) -> Column:
    return F.concat(_fixed(fraction * 100, digits), F.lit("%"))


def duration_text(start: Column, end: Column) -> Column:
    """Whole minutes between two times (text): 42m, 1h, 1h 5m; - if there are none or a time can't be read."""
    ms = (epoch_ms(end) - epoch_ms(start)).cast("bigint")
    minutes = F.floor(ms / 60_000 + F.lit(0.5))
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    text = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(rest == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m")))
    return F.when(F.coalesce(ms > 0, F.lit(False)), text).otherwise("-")


def countdown_text(target: Column, now_ms: Column) -> Column:
    """Time left: 2d 3h, 3h 5m, 5m; now if there is none or the time can't be read."""
    ms = epoch_ms(target) - now_ms
    minutes = F.floor(ms / 60_000)
    days, hours, rest = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    text = F.when(days > 0, F.concat(part(days, "d "), part(hours, "h"))).when(hours > 0, F.concat(part(hours, "h "), part(rest, "m"))).otherwise(part(rest, "m"))
    return F.when(F.coalesce(ms > 0, F.lit(False)), text).otherwise("now")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a time in text; null if it can't be read."""
    return F.unix_millis(ts.try_cast("timestamp"))


def billing_mode(subscription_events: Column, api_events: Column, override: str | None = None) -> Column:
    if override in ("subscription", "api"):
        return F.lit(override)
    return F.when((api_events > 0) & (subscription_events > 0), "mixed").when(api_events > 0, "api").otherwise("subscription")


def billing_label(mode: Column) -> Column:
    return F.when(mode == "api", API_LABEL).otherwise(SUBSCRIPTION_LABEL)
