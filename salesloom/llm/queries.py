"""The operators as registered queries over the whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, embeddings, jaccard, language, maxent, merkle, mixing, packing, pages, sharding,
    substrings, topk, toxicity,
)
from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op8_mixing(spark, d):
    mixed = mixing.in_training_order(mixing.mix(table(spark, d, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position"
    )


ORACLE["op8_mixing"] = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT
        AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tk
    FROM documents
), s AS (
    SELECT source, sum(size)::HUGEINT AS z FROM d GROUP BY source
), w AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * z AS cap
    FROM s
), p AS (
    SELECT *, sum(z) OVER () AS total, sum(w) OVER () AS ws,
        coalesce(sum(cap) OVER o, 0) AS gone, coalesce(sum(w) OVER o, 0) AS gone_w
    FROM w
    WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
    SELECT *, cap * (ws - gone_w) <= (total - gone) * w AS at_cap FROM p
), g AS (
    SELECT *, coalesce(sum(cap) FILTER (at_cap) OVER (), 0) AS c,
        coalesce(sum(w) FILTER (at_cap) OVER (), 0) AS cw
    FROM f
), t AS (
    SELECT source, z, w, CASE WHEN at_cap THEN cap::DOUBLE
        ELSE ((total - c) * w)::DOUBLE / (ws - cw)::DOUBLE END AS target
    FROM g
), q AS (
    SELECT *, floor(target + 0.5)::BIGINT AS quota, (w - 2) * 0.5::DOUBLE AS tilt FROM t
), e AS (
    SELECT d.*, q.z, q.target, q.quota, q.tilt,
        CASE WHEN q.z > 0 THEN (q.quota // q.z)::BIGINT ELSE 1 END AS times,
        coalesce(sum(d.size) OVER (
            PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size, tk
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), h AS (
    SELECT *, quota - times * z::BIGINT AS rest FROM e
), r AS (
    SELECT *, (times + CASE WHEN pos < rest THEN 1 ELSE 0 END)::BIGINT AS copies,
        CASE WHEN quota > 0 THEN pos::DOUBLE / quota::DOUBLE ELSE 0 END AS u, 1 - tilt AS low
    FROM h
)
SELECT doc_id, size, z::BIGINT AS source_size, target,
    (times * size + greatest(0, least(size, rest - pos)))::BIGINT AS taken, copies,
    CASE WHEN copies > 0 THEN 2 * u / (low + sqrt(low * low + 4 * tilt * u)) END AS position
FROM r
"""


@query
def op9_packing(spark, d):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(table(spark, d, "documents"), path))


@query
def op10_sharding(spark, d):
    return sharding.shard(table(spark, d, "documents"))


@query
def op2_jaccard_join(spark, d):
    return jaccard.join(table(spark, d, "documents")).select(
        "doc_id", "class_id", "n_links", "kept"
    )


@query
def op4_topk(spark, d):
    return topk.search(table(spark, d, "embeddings"))


ORACLE["op4_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
        AS rank
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op7_embedding_dedup(spark, d):
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


@query
def op3_html_extraction(spark, d):
    return pages.extract(table(spark, d, "pages"))


@query
def op5_language_id(spark, d):
    return language.language(table(spark, d, "documents"))


@query
def op6_substring_dedup(spark, d):
    return substrings.repeats(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query
def op11_alignment(spark, d):
    import public_tokenizers

    return alignment.align(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@query
def op12_manifest(spark, d):
    return merkle.manifest(table(spark, d, "documents")).drop("lang")


ORACLE["op12_manifest"] = merkle.oracle()


@query
def op13_scoring(spark, d):
    return maxent.score(table(spark, d, "documents"))
