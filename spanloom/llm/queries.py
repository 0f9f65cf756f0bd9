"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import embedding_dedup, fingerprints, language_id, line_dedup, mixing, order_minhash, preferences, quality, sentence_pieces, sharding
from spanloom.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode_documents(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_position").alias("position"), F.col("_block").alias("block"), F.col("_tokens").alias("tokens"), F.round("_weight", 9).alias("weight"), F.round("_exponent", 6).alias("exponent"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_preferences(preferences.spliced_pairs(table(spark, sf_dir, "conversations")))
    masks = {m: preferences.mask_text(F.col(m)) for m in ("chosen_mask", "rejected_mask")}
    return out.withColumns(masks).select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(fingerprints.edited_pairs(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), meta_cols=("n_chars",))
    return quality.score_documents(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_md5")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_line_dedup, op2_sentence_pieces, op3_sharding, op4_mixing, op5_preferences, op6_embedding_dedup, op7_fingerprints, op8_language_id, op9_quality, op10_near_dedup)}

#: Conversations render alike in SQL; partners are 2i and 2i + 1.
_RENDER = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
ORACLE_SQL: dict[str, str] = {
    "op5_preferences": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations),
        own AS (SELECT conv_id, max(n) AS n, (conv_id // 2) % (max(n) + 1) AS kept FROM t GROUP BY conv_id),
        side AS (
            SELECT conv_id, 'c' AS side, k, role, text FROM t
            UNION ALL SELECT t.conv_id, 'r', k, role, text FROM t JOIN own USING (conv_id) WHERE k <= kept
            UNION ALL SELECT own.conv_id, 'r', p.k, p.role, p.text FROM own JOIN t p ON p.conv_id = xor(own.conv_id, 1) WHERE p.k > kept),
        paired AS (SELECT own.conv_id, n, p.conv_id IS NOT NULL AS paired FROM own LEFT JOIN (SELECT DISTINCT conv_id FROM t) p ON p.conv_id = xor(own.conv_id, 1)),
        size AS (SELECT conv_id, count(*) AS m FROM side WHERE side = 'r' GROUP BY conv_id),
        differ AS (
            SELECT c.conv_id, min(c.k) AS k FROM side c JOIN side r ON r.conv_id = c.conv_id AND r.k = c.k AND c.side = 'c' AND r.side = 'r'
            WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.conv_id),
        prefix AS (
            SELECT paired.conv_id, paired, CASE WHEN NOT paired THEN 0 WHEN differ.k IS NOT NULL THEN differ.k - 1 ELSE least(n, coalesce(m, 0)) END AS p
            FROM paired LEFT JOIN size USING (conv_id) LEFT JOIN differ USING (conv_id)),
        part AS (
            SELECT side.*, p, paired, {_RENDER} AS line, length(role) + 5 AS opens, length(text) + 8 AS body
            FROM side JOIN prefix USING (conv_id)),
        placed AS (
            SELECT *, CAST(coalesce(sum(opens + body) OVER (PARTITION BY conv_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + opens AS opened
            FROM part WHERE k > p),
        done AS (
            SELECT conv_id, side, string_agg(line, '' ORDER BY k) AS line,
                   string_agg(CAST(opened AS VARCHAR) || '-' || CAST(opened + body AS VARCHAR), ',' ORDER BY k) FILTER (role = 'assistant') AS mask
            FROM placed GROUP BY conv_id, side)
        SELECT prefix.conv_id, CAST(p AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt,
               coalesce(c.line, '') AS chosen, CASE WHEN paired THEN coalesce(r.line, '') END AS rejected,
               coalesce(c.mask, '') AS chosen_mask, CASE WHEN paired THEN coalesce(r.mask, '') END AS rejected_mask
        FROM prefix
        LEFT JOIN (SELECT conv_id, string_agg(line, '' ORDER BY k) AS prompt FROM part WHERE side = 'c' AND k <= p GROUP BY conv_id) USING (conv_id)
        LEFT JOIN done c ON c.conv_id = prefix.conv_id AND c.side = 'c'
        LEFT JOIN done r ON r.conv_id = prefix.conv_id AND r.side = 'r'""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (
            SELECT vec_id FROM (SELECT vec_id, unnest(e) AS x FROM v)
            GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0)),
        good AS (SELECT vec_id, e FROM v JOIN usable USING (vec_id)),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least_of AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least_of LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)""",
}
