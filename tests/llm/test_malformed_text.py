"""Texts that aren't UTF-8 fail no job: what is malformed counts as U+FFFD."""

import pytest
from pyspark.sql import functions as F

from meterlake.llm import decontam, langid, lmscore, media, packing, secrets, simhash
from meterlake.llm.queries import tokenizer_path

from .conftest import SCHEMA


@pytest.fixture(scope="module")
def malformed(spark, tmp_path_factory):
    rows = spark.createDataFrame([(1, "password=abcdef ", "en", "s", 1), (2, "der die und", "de", "s", 1)], SCHEMA)
    bad = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE")))
    place = f"file://{tmp_path_factory.mktemp('malformed')}/t"
    rows.withColumn("text", bad).write.parquet(place)
    return spark.read.schema(SCHEMA).parquet(place), rows.withColumn("text", F.concat("text", F.lit("\ufffd\ufffd")))


def test_spans_tokens_and_payloads_are_of_the_replaced_text(malformed):
    spans = lambda df: sorted(map(tuple, df.select("doc_id", secrets.secret_spans(F.col("text")).alias("f")).select("doc_id", "f.spans").collect()))
    packed = lambda df: sorted((r.doc_id, bytes(r.token_ids)) for r in packing.pack_documents(df, tokenizer_path()).collect())
    stored = lambda df: sorted((r.doc_id, bytes(r.payload)) for r in media.text_media(df).collect())
    for f in (spans, packed, stored):
        assert f(malformed[0]) == f(malformed[1]) and len(f(malformed[0])) == 2


def test_no_operator_fails(spark, malformed):
    df = malformed[0]
    items = spark.createDataFrame([(1, "some item of words here")], "item_id bigint, text string")
    assert decontam.find_leaks(df, items).count() == 2
    assert langid.identify(df, df).count() == 2
    assert len(lmscore.backoff_scores(df).collect()) == 2
    assert len(simhash.near_duplicates(df).collect()) == len(simhash.drop_near_copies(df).collect()) == 2
