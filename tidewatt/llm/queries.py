"""Registered queries of the training-data operators: each applies its
operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, conversation_repair, decontaminate, divergence, jaccard_join, katz, license_scan, oracles, pii, pu_quality, quality_rules, suffix_dedup, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.read_table(spark, sf_dir, "documents"))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(common.read_table(spark, sf_dir, "documents"))
    base = F.arrays_zip("starts", "kinds", "ends")
    base = F.transform(base, lambda x: F.struct(x["starts"].alias("start"), x["kinds"].alias("kind"), x["ends"].alias("end")))
    kinds = F.array(*map(F.lit, pii.KINDS))
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"),
                        named(F.array_sort(F.concat(base, "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(common.read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op5_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedupe(common.read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
                        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "has_passage")


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return katz.score(docs, common.crc_mod(F.col("doc_id"), 7) == 2)


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    encoded = bpe.encode(docs, TOKENIZER, bpe.build_lexicon(docs, TOKENIZER), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_tiled_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.linked(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.histories(common.read_table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = pu_quality.score(docs, labels, common.crc_mod(F.col("doc_id"), 4) == 2)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_skyband_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.read_table(spark, sf_dir, "documents"))


def op12_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels, common.crc_mod(F.col("doc_id"), 4) == 2)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "offending")


def op13_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(common.read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_license_compression, op2_skip_chain_pii, op3_prefix_decontamination, op4_adaptive_quality, op5_radix_suffix_dedup,
                                   op6_katz_scores, op7_transducer_bpe, op8_tiled_jaccard_join, op9_warc_index_merge,
                                   op10_positive_unlabelled_quality, op11_skyband_divergence, op12_noisy_or_toxicity,
                                   op13_branch_and_bound_repair)}
#: The others have no SQL form; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_prefix_decontamination": oracles.OP3,
    "op4_adaptive_quality": oracles.op4(quality_rules.MEASURES),
    "op8_tiled_jaccard_join": oracles.OP8,
    "op9_warc_index_merge": oracles.OP9,
    "op11_skyband_divergence": oracles.op11(least_docs=30, ranks=50),
    "op13_branch_and_bound_repair": oracles.OP13,
}
