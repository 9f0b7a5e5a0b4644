"""Corpus pipeline: documents through quality rules, near-duplicate removal,
benchmark decontamination, masking of personal data and BPE encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatt.llm import bpe, common, decontaminate, jaccard_join, pii, quality_rules
from tidewatt.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.keep_clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets."""
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and the text decoded from them."""
    return bpe.encode(docs, TOKENIZER, bpe.build_lexicon(docs, TOKENIZER), decoded=True)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", keep_uncontaminated),
    ("PII", mask_personal),
    ("BPE encoding and decoding", encode),
]

#: Quantile sketches, links and merges are beyond SQL; tests hold the run
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
