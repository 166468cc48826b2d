"""The corpus pipeline: stages in order, each over all that the one before kept.

Language identification and the quality classifier drop what they reject, the n-gram join
keeps one document of each group, the secret scan replaces secrets by a mark, and packing
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from popquilt.llm import jaccard, langid, packing, quality, secrets
from popquilt.llm.common import prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told."""
    prepare(spark)
    return langid.known_language(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the weak-label scorer finds bad."""
    prepare(spark)
    return quality.good_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates, and rows apart that share only a doc_id."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    prepare(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", good),
    ("one_of_each", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: The classifiers are trained and packing cuts freely, so SQL can't give these rows.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``run`` has made, on whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written in the shared folder and read again.

    A stage's input is removed as soon as its output is there; the last output stays for whoever reads the result.
    """
    prepare(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{shared}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
