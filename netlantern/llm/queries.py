"""The registered queries of the corpus operators, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from netlantern.llm import (
    byte_bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    lexical_search,
    packing,
    quality,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_prefix,
    toxicity,
    warc,
)
from netlantern.llm.common import held_out, table

LIMIT = 1024


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf, "embeddings"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    nearest = F.get(F.col("t.neighbours"), F.lit(0))
    return toxicity.with_toxicity(docs, model, "t").select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        nearest["id"].alias("nearest_id"),
        nearest["cosine"].alias("nearest_cosine"),
    )


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = token_prefix.token_prefixes(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT
    )
    return found.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_points"
    )


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.with_quality(docs, model, "score").select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_dedup.simhash_classes(table(spark, sf, "documents"))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf, "documents"), ranks), ranks)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf, "pages"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_sharding,
        op3_embedding_dedup,
        op4_toxicity,
        op5_token_counts,
        op6_quality,
        op7_simhash_dedup,
        op8_byte_bpe,
        op9_packing,
        op10_warc,
        op11_hard_negatives,
        op12_lexical_search,
        op13_suffix_dedup,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
        FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN counts USING (vec_id)""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
            FROM pages)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
                        >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM p""",
    "op11_hard_negatives": """
        WITH p AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
                   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT a, b, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT x.a AS anchor_id, x.b AS positive_id,
               CAST(row_number() OVER (PARTITION BY x.a, x.b ORDER BY s.score DESC, s.b) AS INTEGER)
                   AS rank,
               s.b AS negative_id, x.score AS positive_score, s.score AS negative_score
        FROM positives x JOIN s ON s.a = x.a AND NOT s.same
             AND 30 * x.score <= 100 * s.score AND 100 * s.score <= 90 * x.score
        QUALIFY rank <= 10""",
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(
                       text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
        total AS (SELECT count(*) AS d, CAST(sum(n) AS BIGINT) AS l FROM lengths),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        asked AS (
            SELECT DISTINCT item_id, term FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(
                       text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark)),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(
                       CAST(floor(1000 * ln((2 * d + 2) / (2 * df + 1))) AS BIGINT)
                       * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * d) // l)))))
                   AS BIGINT) AS score
            FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), total
            GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                             AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 50""",
}
