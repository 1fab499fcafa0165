"""A training corpus from `documents`: rules, near-duplicates, benchmark, personal data, segmentations.

Every stage takes all documents that the one before kept and returns a table of the same columns, the
last one sampled segmentations. Null or empty texts are rejected by the rules; repeated ids are one
document to the near-duplicate stage; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, read_table
from glyphmill.llm.decontaminate import drop_leaks
from glyphmill.llm.neardup import near_duplicates
from glyphmill.llm.pieces import sample_segmentations
from glyphmill.llm.privacy import pseudonymise
from glyphmill.llm.rules import fit, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return keep_good(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the smallest id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become format-preserving pseudonyms; n_chars follows."""
    return pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentencepiece_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each text, drawn without replacement."""
    # a smaller store of words: executors hold what other stages left, too
    return sample_segmentations(docs, store_nodes=1 << 19)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("sentencepiece segmentations", sentencepiece_segmentations),
]

#: Neither the forest nor the samples can be expressed in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    scratch, docs = Scratch(spark), read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
