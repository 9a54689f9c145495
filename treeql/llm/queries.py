"""The queries of this subpackage's operators: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeql.llm._common import crc_of_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> str:
    """Where the machine keeps a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"), keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.language_id import fit, identify, public_pieces

    documents = table(spark, sf_dir, "documents")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    model = fit(documents, public_pieces(public_file("piece_bpe_32k.model")), ~held_out)
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.decontamination import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.kd_sharding import shard_documents

    shards = shard_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "class_id", "n_links", "class_size")


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.ann_forest import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.warc_archive import archive_and_read

    records = archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.substring_dedup import digest, repeated_spans

    return digest(repeated_spans(table(spark, sf_dir, "documents")))


def op9_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.ctw_lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), crc_of_id(F.col("doc_id")) % 10 != 0)
    doc_id = F.col("key").cast("long")
    return scored.select(doc_id.alias("doc_id"), (crc_of_id(F.col("key")) % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_bits")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeql.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_count, op2_language_id, op3_decontamination, op4_kd_sharding, op5_ngram_join, op6_ann_forest, op7_warc_archive, op8_substring_dedup, op9_ctw_scoring, op10_mixing)}

#: What plain SQL can say: exact joins of windows, shingles and payloads. Tests hold the other queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT n FROM q),
w AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, widths WHERE len(ws) >= n)),
m AS (SELECT DISTINCT w.r, w.i, w.n, q.item_id FROM w JOIN q ON w.k = q.k AND w.n = q.n),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r""",
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.k = q.k AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id) x JOIN n u ON u.doc_id = x.a JOIN n v ON v.doc_id = x.b WHERE x.c * 10 >= 8 * (u.n + v.n - x.c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a)
SELECT c.doc_id, class_id, coalesce(l.n_links, 0) AS n_links, class_size FROM c LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = c.doc_id""",
    "op7_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM t""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h JOIN again ON h.k = again.k),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT words.doc_id, string_agg(words.w, ' ' ORDER BY words.p) AS body, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
