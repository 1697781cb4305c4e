"""The registered queries of the corpus operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_tokens, encode_documents
from .common import table
from .decontaminate import find_contamination
from .divergence import audit_sources
from .licenses import scan_licenses
from .media import text_as_media
from .mixing import curriculum_documents
from .quality import held_out, score_documents, train
from .secrets import secret_spans
from .sharding import assign_shards
from .simhash import simhash_components
from .urls import filter_urls
from .warc import derivatives, responses_from_pages
from .whitening import whiten


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    line = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.col("base")[i].alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))],
        F.col("digest").alias("base_sha256"),
        F.array_join(line, ",").alias("spans"),
    )


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = text_as_media(table(spark, sf_dir, "documents"), with_media=False)
    return stored.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "carved"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no paths: source, language and thousand of ids stand for folders
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan_licenses(table(spark, sf_dir, "documents"), "doc_id", path)
    return found.select(
        F.col("id").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), F.array_join("licenses", ",").alias("licenses"),
        "is_license_file", "effective", "inherited_from",
    )


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses_from_pages(table(spark, sf_dir, "pages")))
    return made.select(
        F.col("key").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest",
        "block_digest", F.octet_length("block").cast("bigint").alias("content_length"), F.sha2("block", 256).alias("block_sha256"),
    )


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_documents(table(spark, sf_dir, "documents"))
    nine = lambda c: F.round(F.col(c), 9).alias(c)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", nine("position"), nine("last_position"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    # the decoder passes its rows on with the tokens they came from
    decoded = decode_tokens(encoded, keep=True)
    return decoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings"))
    return white.select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error"
    )


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_lpt_sharding": op3_lpt_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_media_sniffing": op5_media_sniffing,
    "op6_license_scan": op6_license_scan,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_decontamination": op9_decontamination,
    "op10_nbsvm_quality": op10_nbsvm_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_tiled_whitening": op13_tiled_whitening,
}

from .oracles import ORACLE_SQL  # noqa: E402,F401
