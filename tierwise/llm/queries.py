"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tierwise.llm import (
    byte_bpe, decontaminate, exact_dedup, hard_negatives, importance, near_dedup, oracle, spot_signatures, substring_dedup,
    token_counts, token_files, toxicity, url_templates, warc,
)
from tierwise.llm.shared import ready, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = token_files.write(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    found = token_files.read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op7_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spot_signatures.edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        spot_signatures.fingerprint("signatures").alias("fingerprint"),
        spot_signatures.fingerprint("edited_signatures").alias("edited_fingerprint"),
        spot_signatures.likeness("signatures", "edited_signatures").alias("near_edited"),
        spot_signatures.likeness("signatures", "next_signatures").alias("near_next"),
    )


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = "byte_bpe_multi_50k.tiktoken"
    ids = byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, *warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("bucket", "chain")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NATIVE = ("op3", "op6", "op7", "op12")  # these run no Python on executors


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ready(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_url_templates": op3_url_templates,
        "op4_token_files": op4_token_files,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_spot_signatures": op7_spot_signatures,
        "op8_byte_level_bpe": op8_byte_level_bpe,
        "op9_warc": op9_warc,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_importance_resampling": op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }
    return {name: query if name.split("_")[0] in NATIVE else _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
