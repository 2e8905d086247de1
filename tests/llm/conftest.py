import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split(),
}


def make_text(lang, n, rng):
    words = WORDS[lang]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing" if lang == "en" else "ung"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(k, make_text(lang, 40, rng), lang, "s", 1) for k, lang in enumerate(["en", "de"] * 15)]
    long = make_text("en", 30_000, rng)
    return [*rows, rows[0], rows[0], (None, rows[1][1], None, None, None), (100, None, "en", "s", 0), (101, "", "de", "s", 0), (102, " \n\t", None, "s", 3),
            (103, "12345 !!", "en", "s", 8), (104, long, "en", "s", len(long)), (104, long, "en", "s", len(long)), (105, "ein Wort", "de", None, 8), (106, "\n".join([rows[2][1]] * 3), "en", "s", 0)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a table with extra columns that clash with names used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    extra = ("_row", "_gone", "_language", "_leaks", "piece", "size", "shard", "score", "_text", "_id", "n", "token")
    return df.select("*", *(F.lit(f"x-{c}").alias(c) for c in extra)).repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
