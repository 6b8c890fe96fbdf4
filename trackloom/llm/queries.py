"""The thin queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_facts
from .decontaminate import find_leaks
from .fingerprints import fingerprint_pairs
from .importance import DRAW_SQL, draw_scores
from .licenses import scan_licenses
from .merkle import MANIFEST_SQL, proved, tampered_leaf, write_manifest
from .mixing import MIX_SQL, mix
from .near_duplicates import near_duplicates
from .pii import find_pii, spans_text
from .quality import held_out, score_quality, train
from .setsketch import COPIES_SQL, near_copies
from .tables import new_path
from .token_files import read_index, write_tokens
from .warc import PAGES_SQL, archive_pages, archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts hold the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_facts(rows.unionByName(more))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base, detected = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        found.id.alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, detected)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links (other documents of similarity >= 0.8), n_text_links (different texts), n_copies."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(found.id.alias("doc_id"), "class_id", "n_links", "n_text_links", "n_copies")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, n_words, distance, similarity: a row for each document and benchmark item found in it."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(found.id.alias("doc_id"), found["item"].alias("item_id"), "start", found.words.alias("n_words"), "distance", "similarity")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark, archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_index(spark, folder).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(table(spark, sf_dir, "documents"))
    return mixture.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        found.id.alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), "n_added",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_manifest(table(spark, sf_dir, "documents"), new_path(spark, "manifest"), held={"claimed": tampered_leaf()})
    return proved(manifest).withColumnRenamed("id", "doc_id")


def op12_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draw_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(drawn.id.alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chat_formatting,
        op2_license_scan,
        op3_ngram_jaccard_join,
        op4_benchmark_decontamination,
        op5_warc,
        op6_quality_classifier,
        op7_document_fingerprints,
        op8_token_id_output,
        op9_mixing,
        op10_pii,
        op11_merkle_manifest,
        op12_setsketch_dedup,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": PAGES_SQL, "op9_mixing": MIX_SQL, "op11_merkle_manifest": MANIFEST_SQL, "op12_setsketch_dedup": COPIES_SQL, "op13_importance_resampling": DRAW_SQL}
