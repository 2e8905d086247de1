"""The corpus operators as registered queries: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold

TOKENIZER = "word_bpe_49k.json"

OP6_SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
tok AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc),
uni AS (SELECT w, count(*) AS n FROM tok GROUP BY w),
c1 AS (SELECT * FROM uni),
tot AS (SELECT count(*) AS n FROM tok),
bi AS (SELECT a.r, a.w AS v, b.w AS u FROM tok a LEFT JOIN tok b ON b.r = a.r AND b.i = a.i - 1),
c2 AS (SELECT u, v, count(*) AS n FROM bi WHERE u IS NOT NULL GROUP BY u, v),
part AS (SELECT bi.r, CASE WHEN bi.u IS NULL THEN ln(v1.n) - ln(tot.n) WHEN c2.n >= 2 THEN ln(c2.n) - ln(u1.n)
    ELSE ln(0.4) + ln(v1.n) - ln(tot.n) END AS s, CASE WHEN bi.u IS NOT NULL AND c2.n < 2 THEN 1 ELSE 0 END AS back
  FROM bi CROSS JOIN tot JOIN c1 v1 ON v1.w = bi.v LEFT JOIN c1 u1 ON u1.w = bi.u LEFT JOIN c2 ON c2.u = bi.u AND c2.v = bi.v),
per AS (SELECT r, sum(s) AS s, sum(back) AS back FROM part GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(coalesce(back, 0) AS BIGINT) AS n_backoff, round(coalesce(s, 0), 4) AS score
FROM doc LEFT JOIN per ON per.r = doc.r
"""

OP11_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
tok AS (SELECT r, lang, source, unnest(ws) AS term FROM doc),
grp AS (SELECT DISTINCT lang, source FROM doc),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM grp JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN tot t USING (lang, source) LEFT JOIN cnt c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM grp g JOIN grp h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""

OP12_SQL = """
WITH every AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS anchor_label, b.r, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM every a JOIN every b ON b.r <> a.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.ar, pr ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored s ON s.ar = pos.ar AND label <> anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    found = identify(docs, docs.filter(~held_out), into="_language")
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"),
        F.col("_language.bits_per_byte").alias("bits_per_byte"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import similar_lines

    return similar_lines(documents(spark, sf_dir)).select("doc_id", "line_no", "class_id", "match_id", "removed", "n_links")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import Capacity, pack_documents

    packed = pack_documents(documents(spark, sf_dir), tokenizer_path(), capacity=Capacity(tokens=2048))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    found = find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_m")
    each = found.select("doc_id", F.explode("_m").alias("_m"))
    return each.select("doc_id", *(F.col(f"_m.{c}").alias(c) for c in ("item_id", "start_word", "end_word", "bits", "similarity")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    rows = shard_by_bytes(documents(spark, sf_dir), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "key_range",
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import backoff_scores

    rows = backoff_scores(documents(spark, sf_dir))
    return rows.select("doc_id", "n_tokens", "n_backoff", F.round("score", 4).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_score, train

    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(docs, labels, keep=~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxic_score(spark, weights, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    found = documents(spark, sf_dir).select("doc_id", secret_spans(F.col("text")).alias("_found"))
    return found.select(
        "doc_id", *(F.col(f"_found.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex")),
        F.sha2(F.col("_found.base"), 256).alias("base_sha256"), F.col("_found.spans").alias("spans"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    docs = documents(spark, sf_dir)
    rows = text_media(docs)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(documents(spark, sf_dir), min_docs=10, top=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec, label = F.col("vec_id"), F.col("label").cast("bigint")
    moved = rows.withColumn("label", F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, vec % 100 == 0, scale=256.0, positives=5, negatives=5, floor=(4, 5))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_to_ids, judge

    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    found = judge(docs.select("doc_id", "text"), fit_to_ids(docs, good), into="_q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return found.select("doc_id", *(F.col(f"_q.{c}").alias(c) for c in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_line_dedup, op3_packing, op4_decontamination, op5_sharding, op6_lm_score, op7_toxicity, op8_secrets, op9_media, op10_simhash,
                                      op11_divergence, op12_hard_negatives, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op6_lm_score": OP6_SQL, "op11_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL}
