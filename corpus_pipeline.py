"""The corpus pipeline: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from railbird.llm import decontam, packing, pii, quality, simhash
from railbird.llm.queries import tokenizer
from railbird.llm.similar import SIMILARITY
from railbird.llm.stage import find_package, materialize, only_last_stays


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; documents that are more likely poor than good, or more likely toxic than not, go.

    Null texts are judged like empty ones; repeated rows have one fate; without labels all
    evidence is neutral.  Other columns stay as they are, whatever their names.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; one document of each group stays, that with the least id.

    Linked are fingerprints of four or fewer differing bits, and texts whose five-word shingles
    have a similarity of 0.8 or more.  Null and empty texts are one group.  Documents with one
    id and different texts are different documents; of rows that are the same one stays.
    """
    return simhash.drop_near_duplicates(docs, similarity=SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; documents with words of a benchmark window go.

    Null and empty texts stay, as does everything without a benchmark; repeated rows have one fate.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; personal data and what discloses it is replaced in the texts, and n_chars set anew.

    No row goes; null texts stay null; repeated rows have one text after as before.
    """
    return pii.sanitize(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; a row per piece, with its place in a sequence.

    Null and empty texts are a piece of one id; repeated rows are pieces of their own; other
    columns are left out.  An empty table gives an empty result, here as in all stages.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier, XXH64 fingerprints and byte-pair tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with only_last_stays(spark):  # what the stage wrote on its way goes
            docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
