"""The corpus pipeline: stages over documents, each written as Parquet and read again.

A stage takes any documents(doc_id, text, source, ...): null ids, null, empty and very long texts,
repeated rows, an empty table, and columns of any further name, which go along in all stages but
the last. What each does with odd rows stands in the docstring of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import mixing, nearcopies, packing, quality, toxicity
from emberlog.session import scratch, shared_dir


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score as toxic go; texts that are null or empty stay."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir, "toxic"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compress like bad text go; texts that are null or empty score as the calibration has it."""
    return quality.keep_good(docs, _labels(spark, sf_dir, "quality"), threshold=QUALITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id.

    The trie self-join links fingerprints of five-word shingles at 2 bits. Near copies that share
    just 0.8 of their shingles lie up to 17 bits apart, which no bit budget of the trie affords;
    MinHash bands and exact overlaps find those among what the trie leaves apart.
    """
    return nearcopies.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and cut to their target weights; texts without words are not taken."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words go into sequences of permitted lengths: a row for each segment."""
    return packing.pack_documents(docs)


#: What the classifier rejects goes: as in op5, a score under 0.5 predicts bad text.
QUALITY = 0.5

STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Stages learn models and hash texts, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage reads what the one before has written.

    What the operators of a stage have stored on the way is removed once its result is written; what
    other results still read stays.
    """
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
