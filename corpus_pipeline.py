"""A corpus pipeline: language, lines, near-duplicates, benchmark leaks, then packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder
and reads them back as the next one's ``docs``. All stages but the last keep the columns of the documents.

Defined cases: a null or empty text, or one without a letter, has no language and goes in the first stage. Repeated rows are near copies
of each other: the first one stays; of equal ids the first row of the input, null ids last. Very long texts are read whole. An empty
table ends as an empty result. Extra columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import free_name, shared_dir
from meterlake.llm.decontam import find_leaks
from meterlake.llm.langid import UNDETERMINED, identify
from meterlake.llm.linededup import dedup_lines
from meterlake.llm.packing import Capacity, pack_documents
from meterlake.llm.queries import tokenizer_path
from meterlake.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents without a language (null or no letter). Null or wrong labels become the language found."""
    into = free_name(docs, "_language")
    found = identify(docs, docs, into=into).filter(F.col(f"{into}.lang") != UNDETERMINED)
    return found.withColumn("lang", F.col(f"{into}.lang")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line go, and documents of which nothing is left."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id (null last): documents whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more. Texts without words are one group."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents that hold a benchmark item."""
    into = free_name(docs, "_leaks")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=into)
    return found.filter(F.size(into) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its token ids, sequence and offset."""
    return pack_documents(docs, tokenizer_path(), capacity=Capacity(tokens=2048))


STAGES = [
    ("language", language), ("line_dedup", lines), ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate), ("packing", pack),
]

#: No stage but the joins can be told in SQL: byte contexts, fingerprints and token ids can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
