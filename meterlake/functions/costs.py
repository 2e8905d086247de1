"""The rate card and what an event costs by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE_SCHEMA = "prefix string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double"

#: US dollars a token by model-id prefix (input, output, cache read, 5m write, 1h write).
RATES = (
    ("claude-opus-4-5", 5e-6, 2.5e-5, 5e-7, 6.25e-6, 1e-5),
    ("claude-opus-4-6", 5e-6, 2.5e-5, 5e-7, 6.25e-6, 1e-5),
    ("claude-opus-4-7", 5e-6, 2.5e-5, 5e-7, 6.25e-6, 1e-5),
    ("claude-opus-4-8", 5e-6, 2.5e-5, 5e-7, 6.25e-6, 1e-5),
    ("claude-opus-4-1", 1.5e-5, 7.5e-5, 1.5e-6, 1.875e-5, 3e-5),
    ("claude-opus-4-0", 1.5e-5, 7.5e-5, 1.5e-6, 1.875e-5, 3e-5),
    ("claude-opus-4-20250514", 1.5e-5, 7.5e-5, 1.5e-6, 1.875e-5, 3e-5),
    ("claude-3-opus", 1.5e-5, 7.5e-5, 1.5e-6, 1.875e-5, 3e-5),
    ("claude-sonnet-", 3e-6, 1.5e-5, 3e-7, 3.75e-6, 6e-6),
    ("claude-3-5-sonnet", 3e-6, 1.5e-5, 3e-7, 3.75e-6, 6e-6),
    ("claude-3-7-sonnet", 3e-6, 1.5e-5, 3e-7, 3.75e-6, 6e-6),
    ("claude-haiku-", 1e-6, 5e-6, 1e-7, 1.25e-6, 2e-6),
    ("claude-3-5-haiku", 8e-7, 4e-6, 8e-8, 1e-6, 1.6e-6),
    ("claude-fable-", 1e-5, 5e-5, 1e-6, 1.25e-5, 2e-5),
    ("gpt-5.1-codex-mini", 2.5e-7, 2e-6, 2.5e-8, 0.0, 0.0),
    ("gpt-5.1-codex", 1.25e-6, 1e-5, 1.25e-7, 0.0, 0.0),
    ("gpt-5.1", 1.25e-6, 1e-5, 1.25e-7, 0.0, 0.0),
    ("gpt-5-codex", 1.25e-6, 1e-5, 1.25e-7, 0.0, 0.0),
    ("gpt-5-mini", 2.5e-7, 2e-6, 2.5e-8, 0.0, 0.0),
    ("gpt-5-nano", 5e-8, 4e-7, 5e-9, 0.0, 0.0),
    ("gpt-5", 1.25e-6, 1e-5, 1.25e-7, 0.0, 0.0),
    ("codex-mini", 1.5e-6, 6e-6, 3.75e-7, 0.0, 0.0),
    ("gpt-5.3-codex", 1.75e-6, 1.4e-5, 1.75e-7, 0.0, 0.0),
    ("gpt-5.4-mini", 7.5e-7, 4.5e-6, 7.5e-8, 0.0, 0.0),
    ("gpt-5.4-nano", 2e-7, 1.25e-6, 2e-8, 0.0, 0.0),
    ("gpt-5.4-pro", 3e-5, 0.00018, 0.0, 0.0, 0.0),
    ("gpt-5.4", 2.5e-6, 1.5e-5, 2.5e-7, 0.0, 0.0),
    ("gpt-5.5-pro", 3e-5, 0.00018, 0.0, 0.0, 0.0),
    ("gpt-5.5", 5e-6, 3e-5, 5e-7, 0.0, 0.0),
    ("gpt-5.6-sol", 5e-6, 3e-5, 5e-7, 0.0, 0.0),
    ("gpt-5.6-terra", 2.5e-6, 1.5e-5, 2.5e-7, 0.0, 0.0),
    ("gpt-5.6-luna", 1e-6, 6e-6, 1e-7, 0.0, 0.0),
)


def rate_card(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES), RATE_SCHEMA)


def fixed_rate(model: Column) -> Column:
    """The struct of the rate card's longest prefix of ``model``, null if there is none: one expression, no join."""
    names = [c.split()[0] for c in RATE_SCHEMA.split(", ")][1:]
    found = F
    for prefix, *rates in sorted(RATES, key=lambda r: -len(r[0])):
        found = found.when(model.startswith(prefix), F.struct(*(F.lit(float(x)).alias(c) for c, x in zip(names, rates, strict=True))))
    return found


def with_rates(events: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Adds a struct ``rate`` (null if none applies): that of the longest prefix of ``model``.

    Rates other than the fixed ones are matched with the different models, then joined to the events by equality.
    """
    if rates is None:
        return events.withColumn("rate", fixed_rate(F.col("model")))
    models = events.select("model").distinct()
    found = models.join(F.broadcast(rates), F.startswith("model", "prefix")).groupBy("model").agg(  # a rate card is short
        F.max_by(F.struct(*[c for c in rates.columns if c != "prefix"]), F.length("prefix")).alias("rate")
    )
    return events.join(found, "model", "left")


def prefix_counts(events: DataFrame) -> DataFrame:
    """(prefix, events): how many events each prefix of the fixed card prices."""
    found = F
    for prefix, *_ in sorted(RATES, key=lambda r: -len(r[0])):
        found = found.when(F.col("model").startswith(prefix), prefix)
    return events.groupBy(found.alias("prefix")).agg(F.count("*").alias("events")).filter("prefix IS NOT NULL")


def estimated_cost() -> Column:
    """Dollars from the token columns and ``rate``; cache writes of no named tier cost the 5m rate."""
    positive = lambda c: F.greatest(F.col(c), F.lit(0)).cast("double")
    one, five, made = (positive(c) for c in ("cache_1h_tokens", "cache_5m_tokens", "cache_creation_tokens"))
    rest = F.greatest(made - one - five, F.lit(0.0))
    tokens = lambda c: F.col(c).cast("double")
    return (
        tokens("input_tokens") * F.col("rate.input") + tokens("output_tokens") * F.col("rate.output")
        + tokens("cache_read_tokens") * F.col("rate.cache_read") + one * F.col("rate.cache_write_1h")
        + (five + rest) * F.col("rate.cache_write_5m")
    )


def price(events: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Fills ``cost_usd`` where it is null, as an estimate; models without a rate stay null. Costs given stay as they are."""
    priced = with_rates(events, rates)
    given = F.col("cost_usd").isNotNull()
    return priced.withColumns(
        {
            "cost_basis": F.when(given, F.col("cost_basis")).otherwise("estimated"),
            "cost_usd": F.when(given, F.col("cost_usd")).otherwise(estimated_cost()),
        }
    ).select(*events.columns)


def unknown_models(events: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """The models, in order, of events that stay without a cost."""
    return price(events, rates).filter("cost_usd IS NULL").select("model").distinct().orderBy("model")


def micro_usd(cost: Column) -> Column:
    return F.round(cost * 1_000_000).cast("bigint")
