"""The operators as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.alignment import alignment_counts
from monthloom.llm.decontaminate import contamination
from monthloom.llm.jaccard import similar_classes
from monthloom.llm.licenses import scan_licenses, templates
from monthloom.llm.negatives import hard_negatives
from monthloom.llm.packing import pack
from monthloom.llm.phrases import repeated_passages
from monthloom.llm.quality import ByteConvNet, fit, score
from monthloom.llm.secretscan import LEDGER, RULES, findings_by_path, scan, span_text
from monthloom.llm.suffixes import repeated_spans
from monthloom.llm.tokenfiles import token_files
from monthloom.llm.topk import top_k, whole_components
from monthloom.llm.urls import HostRule, filter_urls
from monthloom.llm.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
# The rules of the url query.
URL_RULES = [
    HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"),
]
# The method's own list: hosts that sell or spam, and files that are not pages.
BLOCKED_URLS = ["*spam*.*/**", "*pills*.*/**", "*casino*.*/**", "*/**.exe", "*/**.zip"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def q_urls(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), URL_RULES, BLOCKED_URLS)


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def q_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_digest(pack(table(spark, folder, "documents"), TOKENIZER, window=1024, end_id=0))


def q_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", whole_components(F.col("embedding")).alias("vector"))
    return top_k(rows.where("vec_id % 100 = 0"), rows, k=10)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_net(spark: SparkSession, docs: DataFrame, folder: str) -> ByteConvNet:
    return fit(docs, table(spark, folder, "labels").where(~held_out(F.col("doc_id"))))


def q_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs, quality_net(spark, docs, folder))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def q_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents"), least=400)


def q_similar(spark: SparkSession, folder: str) -> DataFrame:
    return similar_classes(table(spark, folder, "documents"), k=4, percent=85).drop("key", "component")


def q_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"), templates(spark))


def q_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "overlap")


def q_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), TOKENIZER, end_id=2).withColumnRenamed("key", "doc_id")


def q_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs, ledger = table(spark, folder, "documents"), new_folder(spark, "ledger")
    scan(docs).write.parquet(ledger)
    found = findings_by_path(docs, spark.read.schema(LEDGER).parquet(ledger))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda f: f["base"])
    return found.select(
        "doc_id", *(count(r.kind) for r in RULES if r.base), F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )


def q_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"), width=13)


def q_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    emb = table(spark, folder, "embeddings")
    relabelled = emb.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(relabelled, F.col("vec_id") % 100 == 0, positives=5, negatives=5, scale=256)


def q_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment_counts(table(spark, folder, "documents"), TOKENIZER, PIECE_TOKENIZER)


QUERIES: dict[str, Query] = {
    "op1_url_filter": q_urls,
    "op2_concatenate_and_cut": q_packing,
    "op3_maxscore": q_topk,
    "op4_quality_network": q_quality,
    "op6_difference_cover_repeats": q_repeats,
    "op7_multiple_order_jaccard": q_similar,
    "op5_license_scan": q_licenses,
    "op8_spaced_seed_decontamination": q_decontamination,
    "op9_token_files": q_token_files,
    "op10_secret_ledger": q_secrets,
    "op11_phrase_automata": q_passages,
    "op12_triangle_negatives": q_hard_negatives,
    "op13_diagonal_alignment": q_alignment,
}
