"""The operators' queries: each reads its whole table and returns its whole
result. ``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame, ``ORACLE_SQL``
to DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.audit import filter_audit
from terrane.llm.bpe import bpe_roundtrip_digests
from terrane.llm.common import documents, table
from terrane.llm.exact import exact_decisions
from terrane.llm.negatives import hard_negatives
from terrane.llm.ngram_join import near_copy_components
from terrane.llm.packing import pack_documents
from terrane.llm.pii import span_report
from terrane.llm.quality import classify
from terrane.llm.repeats import removal_report
from terrane.llm.sharding import shard_documents
from terrane.llm.tokenfile import token_file_report
from terrane.llm.topk import exact_topk
from terrane.llm.warc import warc_report

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of equal weight by rendezvous hashing."""
    return shard_documents(documents(spark, sf_dir), [1.0] * 40)


def op2_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the pair occurrence index and decoded again."""
    return bpe_roundtrip_digests(documents(spark, sf_dir), BYTE_BPE)


def op3_perfect_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back through the index."""
    return token_file_report(documents(spark, sf_dir), WORD_BPE)


def op4_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids."""
    return pack_documents(documents(spark, sf_dir), BYTE_BPE)


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every 20th vector, exactly."""
    return exact_topk(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that reveal it."""
    return span_report(documents(spark, sf_dir))


def op8_suffix_family_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds, removed
    from all documents."""
    return removal_report(documents(spark, sf_dir))


def op9_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the factorisation machine."""
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document by the digest index."""
    return exact_decisions(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return near_copy_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc_report(table(spark, sf_dir, "pages"))


def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 hardest negatives of each of the 5 positives of every 100th
    vector; every seventh vector has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_failing_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters take from each other in every order, by source."""
    return filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_rendezvous_sharding, op2_pair_index_bpe, op3_perfect_hash_files, op4_certified_packing, op5_block_topk,
        op6_disclosure_pii, op7_digest_index_dedup, op8_suffix_family_repeats, op9_factorisation_quality, op10_adaptive_prefix_join,
        op11_dictionary_warc, op12_bond_negatives, op13_failing_id_audit)}

ORACLE_SQL: dict[str, str] = {
    "op5_block_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT::DOUBLE) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op7_digest_index_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
          FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h)""",
    "op11_dictionary_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
        FROM f""",
    "op12_bond_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 list_inner_product(a.v, c.v)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
                     AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        QUALIFY rank <= 10""",
    "op13_failing_id_audit": r"""
        WITH l AS (
          SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
          FROM labels GROUP BY 1),
        d AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                 list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
          FROM documents),
        m AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (len(w) < 50)::INT + 2 * (100 * list_unique(w) < 65 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT
                 + 16 * coalesce(first IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first), false)::INT AS mask
          FROM d LEFT JOIN l USING (doc_id)),
        c AS (
          SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM m GROUP BY ALL),
        f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
          SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
          FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
        st AS (
          SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS run
          FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (
          SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (mask & (run | bit) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (mask & run = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (mask & run <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (mask & run = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (mask & run = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
          FROM st, c GROUP BY ALL)
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
}
