"""The queries of this folder, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, lattice_lm, lengths, mixing, simhash, tokens, toxicity, ts_media, warc_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_index.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "url")


def op2_transport_stream_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts_media.read_media(ts_media.store_media(table(spark, sf_dir, "documents")))
    first, last = F.expr("points[0].pts"), F.expr("points[size(points) - 1].pts")
    feature = F.format_string("programs=%d packets=%d units=%d random_access=%d first_pts=%d last_pts=%d lost=%d broken=%d damaged=%d", "programs", "packets", "units", F.size("points"), first, last, "lost", "broken", "damaged")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, distance=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_equal")


def op4_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_limits(lengths.length_histogram(table(spark, sf_dir, "documents"), tokens.default_vocabulary()))


def op5_subword_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the whole model's: the training words' counts, backed by the lattice, whose pieces are fitted to the training words. What the lattice alone gives is lattice_score."""
    out = lattice_lm.score_documents(table(spark, sf_dir, "documents"), lattice_lm.default_pieces(), rounds=2)
    return out.withColumnsRenamed({"id": "doc_id", "score": "lattice_score", "smoothed_score": "score"})


def op6_toxicity_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_exact_dedup_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), repetition=2.0).withColumnRenamed("id", "doc_id")


def op9_language_id_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokens.default_vocabulary()).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_warc_capture_index, op2_transport_stream_media, op3_simhash_gray_index, op4_token_length_histogram, op5_subword_lattice_likelihood, op6_toxicity_subword_softmax,
                                     op7_exact_dedup_heavy_hitters, op8_temperature_mixing, op9_language_id_subword_softmax, op10_byte_level_bpe)}

#: Base32 of a SHA-1 in SQL: the hex digits as bits, five at a time.
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '')"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: substr(bits, 5 * i + k, 1)::INT * (1 << (5 - k))))::INT, 1)), '')"

ORACLE_SQL = {
    "op1_warc_capture_index": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             b AS (SELECT *, {_BITS} AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, coalesce(url, 'urn:colloquy:none') AS url
        FROM b""",
    "op7_exact_dedup_heavy_hitters": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
              FROM documents)
        WINDOW w AS (PARTITION BY text_sha256)""",
}
