"""One query per operator, with production parameters over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from . import chat_roles, decontaminate, exact_dedup, jaccard_join, packing, quality, sharding, surrogates, token_records, warc_zip
from .shared import file_system, new_dir, publish, shared_dir


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), new_dir(spark, "tokens"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_records.read_records(spark, manifest)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), max_len=4096, end_id=1)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, num=3, den=4).drop("text_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc_zip.write_packages(table(spark, sf_dir, "pages"), new_dir(spark, "warc"), min_bytes=0)
    return warc_zip.read_packages(spark, paths).drop("package", "offset")


def op6_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_roles.repair(table(spark, sf_dir, "conversations"))


SHARD_BYTES = 1 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def surrogate_key(spark: SparkSession) -> str:
    """The key in spark.latticeframe.surrogateKey; where it is unset, one that is drawn once and kept in the shared folder."""
    if key := spark.conf.get("spark.latticeframe.surrogateKey", ""):
        return key
    uri = f"{shared_dir(spark)}/surrogate.key"
    files, path = file_system(uri)
    if not files.get_file_info(path).is_file:
        publish(uri, lambda out: out.write(secrets.token_hex(32).encode()))
    with files.open_input_stream(path) as f:
        return f.read().decode()


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), surrogate_key(spark))


QUERIES = {f.__name__: f for f in (
    op1_token_records, op2_pattern_packing, op3_jaccard_join, op4_exact_dedup, op5_warc, op6_chat_roles, op7_sharding, op8_quality, op9_decontamination, op10_surrogates,
)}

ORACLE_SQL = {
    "op3_jaccard_join": """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x : x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
    FROM words),
elements AS (SELECT doc_id, len(shingles) AS n, UNNEST(shingles) AS shingle FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, COUNT(*) AS shared
    FROM elements a JOIN elements b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM pairs WHERE 100 * shared >= 75 * (n + m - shared)
    UNION ALL SELECT y, x FROM pairs WHERE 100 * shared >= 75 * (n + m - shared)),
reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY 1) r ON r.doc_id = s.doc_id""",
    "op5_warc": """
WITH payloads AS (
    SELECT page_id, COALESCE(html, '') AS payload, sha1(COALESCE(html, '')) AS hex, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first_id
    FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM payloads""",
    "op4_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS keep_id,
       COUNT(*) OVER (PARTITION BY COALESCE(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents""",
    "op7_sharding": f"""
WITH hashed AS (
    SELECT doc_id, lpad(bin(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT)), 60, '0') AS bits,
           CAST(COALESCE(strlen(text), 0) AS BIGINT) AS bytes
    FROM documents),
nodes AS (
    SELECT d AS depth, substr(bits, 1, d) AS shard, CAST(SUM(bytes) AS BIGINT) AS shard_bytes, COUNT(*) AS shard_rows
    FROM hashed, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 61)) GROUP BY 1, 2),
fits AS (
    SELECT h.doc_id, n.*, ROW_NUMBER() OVER (PARTITION BY h.doc_id ORDER BY n.depth) AS rank
    FROM hashed h JOIN nodes n ON n.shard = substr(h.bits, 1, n.depth) WHERE n.shard_bytes <= {SHARD_BYTES})
SELECT doc_id, shard, depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversized FROM fits WHERE rank = 1""",
}
