"""The corpus pipeline: five operators over `documents`, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and reads it again, so a lost executor costs one stage's tasks at most.

Defined results: a null text is the empty text, kept or dropped as its score says, one piece if it is packed;
rows with a null doc_id are never near-duplicates or contaminated; of repeated rows one stays; rows that share
a doc_id are judged text by text; an empty table gives no rows; extra columns pass through all stages but the last.

Without the operators' subpackage this module cannot be imported; the entry point leaves it out then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontaminate, neardup, packing, quality, secrets


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows of `documents` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask(docs, _path("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its place in a sequence."""
    return packing.pack(docs, _path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Learned scores and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; the result is read back from Parquet, what lies between is deleted."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        common.removed(spark, f"{folder}/{k - 1}")
    return docs
