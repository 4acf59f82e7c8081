"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language, lm, media, mixing, neardup, packing, pii, quality, suffixes, topk
from .common import held_out, table


def tokenizer():
    """(ranks file, pattern) of the 50k byte-level vocabulary; the ids equal those of its .json form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ctw_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), held_out(7))


def op2_media_columns(spark, sf_dir):
    return media.document_media(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4))
    dictionaries = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, dictionaries, {"held_out": F.col("held_out")})


def op8_suffix_dedup(spark, sf_dir):
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("removed")


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer())


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ctw_score, op2_media_columns, op3_ngram_join, op4_mix_sources, op5_exact_topk, op6_quality, op7_language_id, op8_suffix_dedup, op9_packing, op10_pii)}

ORACLE: dict[str, str] = {
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- water-filling: sources that reach their cap are those with the smallest cap per weight
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
             sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_weight FROM s),
l AS (SELECT max((total - cut) / open_weight) AS level FROM o WHERE 3.0 * source_size / weight >= (total - cut) / open_weight),
t AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target,
             CASE WHEN source_size > 0 THEN least(weight * level, CAST(3 * source_size AS DOUBLE)) / source_size ELSE 0.0 END AS e,
             CAST(CAST('0x' || substr(md5(coalesce('s' || source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM s, l),
r AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY t.source ORDER BY d.size, md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor((k + 1) * e + u) - floor(k * e + u), 3) * size AS BIGINT) AS taken FROM r
""",
    "op5_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
}
