"""One query for each operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, quality, sentencepiece_codec, simhash, token_counts, token_shards, topk, toxicity, warc
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_shards.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return index.select("slot", "shard", "row", "doc_ids", "n_tokens", "tokens_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=remainder(3) != 1)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.AdditiveModel:
    return quality.fit(docs, table(spark, sf_dir, "labels"), usable=remainder(5) != 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), budget=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "keep_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"), removed_col="n_removed")
    return docs.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_decontamination, op3_token_shards, op4_toxicity, op5_topk, op6_simhash, op7_quality, op8_token_counts, op9_line_dedup, op10_warc)}

#: DuckDB SQL over the same tables.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
        ), doc_windows AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
        ), found AS (
            SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, i AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        ), full_lines AS (
            SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE replace(line, ' ', '') <> ''
        ), windows AS (
            SELECT a.doc_id, a.pos AS first, c.pos AS last, a.line AS x, b.line AS y, c.line AS z
            FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.n = a.n + 2
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, first) AS r FROM windows
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM ranked WHERE r > 1
        ), joined AS (
            SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS left_text, count(c.pos) AS n_removed
            FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
        ), result AS (
            SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(left_text, '') END AS text
            FROM documents d LEFT JOIN joined j USING (doc_id)
        )
        SELECT doc_id, n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM result
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, CAST(CAST(from_hex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages
        ), k AS (
            SELECT body, max(page_id) AS keeper FROM p GROUP BY body
        )
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(1, 161, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * CAST(bits[i] AS INT) + 8 * CAST(bits[i + 1] AS INT) + 4 * CAST(bits[i + 2] AS INT) + 2 * CAST(bits[i + 3] AS INT) + CAST(bits[i + 4] AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
        FROM p JOIN k USING (body)
    """,
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
}
