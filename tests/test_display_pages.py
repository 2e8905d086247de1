"""Numbers and times as people read them; pages of a sorted table."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import display, times
from meterlake.operators import pages


def texts(spark, column, values, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, n {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("n"))).collect()]


def test_counts_and_costs(spark):
    assert texts(spark, display.tokens_text, [0, 999, 1500, 999_949, 999_950, 999_950_000], "bigint") == ["0", "999", "1.5K", "999.9K", "1M", "1B"]
    assert texts(spark, display.short_tokens_text, [0, -5, 999, 1000, 1500, 99_900, 123_456, 1_000_000, 2_500_000_000, -1500], "bigint") == ["0", "-5", "999", "1K", "1.5K", "99.9K", "123K", "1M", "2.5B", "-1.5K"]
    assert texts(spark, display.count_text, [0, 1234567], "bigint") == ["0", "1,234,567"]
    assert texts(spark, lambda n: display.noun_text(n, "event"), [0, 1, 2000], "bigint") == ["0 events", "1 event", "2,000 events"]
    assert texts(spark, display.cost_text, [None, 0.0, 0.001, 0.005, 1456.837, -2.0, float("nan")], "double") == ["n/a", "$0.00", "<$0.01", "$0.01", "$1,456.84", "$-2.00".replace("$-", "-$"), "n/a"]
    assert texts(spark, display.micro_cost_text, [0, 420_000, 9_994_000, 42_400_000, 1_500_000_000, 123_456_000_000], "bigint") == ["$0.00", "$0.42", "$9.99", "$42", "$1.5K", "$123K"]
    assert texts(spark, display.percent_text, [0.0, 0.256, 1.0], "double") == ["0%", "26%", "100%"] and texts(spark, lambda n: display.percent_text(n, 1), [0.2564], "double") == ["25.6%"]


def test_durations_and_countdowns(spark):
    at = "2026-03-01T10:00:00Z"
    ends = ["2026-03-01T10:00:29Z", "2026-03-01T10:00:30Z", "2026-03-01T10:42:00.000Z", "2026-03-01T11:00:00Z", "2026-03-01T12:05:00+00:00", "2026-03-02T10:00:00Z", at, "2026-03-01T09:00:00Z", "never", None]
    assert texts(spark, lambda n: display.duration_text(F.lit(at), n), ends, "string") == ["0m", "1m", "42m", "1h", "2h 5m", "24h", "-", "-", "-", "-"]
    now = F.lit(1772359200000)  # the same time
    assert texts(spark, lambda n: display.countdown_text(n, now), ends, "string") == ["0m", "0m", "42m", "1h 0m", "2h 5m", "1d 0h", "now", "now", "now", "now"]


def test_range_presets():
    assert times.range_preset("7d", "2026-03-01T10:00:00Z") == ("2026-02-23", "2026-03-01")
    assert times.range_preset("30d", "2026-03-01T10:00:00Z") == ("2026-01-31", "2026-03-01")
    assert times.range_preset("ytd", "2026-03-01T10:00:00Z") == ("2026-01-01", "2026-03-01")


@pytest.mark.parametrize("n", [0, 1, 437])
def test_pages_equal_a_sorted_whole(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(f"s{k}", rng.choice([None, *(f"2026-03-{d:02d}" for d in range(1, 20))]), k) for k in range(n)]
    order, schema = [pages.Order("at", falling=True), pages.Order("id")], "id string, at string, n int"
    total = pages.lay_out(spark.createDataFrame(rows, schema).repartition(5), str(tmp_path), order, rows_per_range=40)
    assert total == n
    want = sorted(rows, key=lambda r: r[0])
    want = sorted(want, key=lambda r: (r[1] is not None, r[1] or ""), reverse=True)
    want = [r for _, r in sorted(enumerate(want), key=lambda x: ((x[1][1] is None), [-ord(c) for c in x[1][1] or ""], x[1][0]))]
    got, number = [], 1
    while True:
        found = pages.page(spark, str(tmp_path), order, schema, number, 25)
        here = [tuple(r) for r in found.collect()]
        if not here:
            break
        assert len(found.inputFiles()) <= 2  # of a dozen
        got += here
        number += 1
    assert got == want
    assert pages.page(spark, str(tmp_path), order, schema, 0, 10_000).count() == min(n, 500)


def test_ranges_are_bounded_and_rows_computed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_RANGES", 4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).withColumn("x", F.col("id") % 7).mapInArrow(count, "id bigint, x bigint")
    order = [pages.Order("x", falling=True), pages.Order("id")]
    assert pages.lay_out(rows, str(tmp_path / "p"), order, rows_per_range=10) == 1000
    assert seen.value == 1000
    assert spark.read.parquet(str(tmp_path / "p" / "counts")).count() <= 4
    want = sorted(range(1000), key=lambda k: (-(k % 7), k))
    got = [r.id for n in (1, 7, 20, 21) for r in pages.page(spark, str(tmp_path / "p"), order, "id bigint, x bigint", n, 50).collect()]
    assert got == [*want[:50], *want[300:350], *want[950:]]
