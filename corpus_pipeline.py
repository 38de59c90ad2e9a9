"""A corpus pipeline over ``documents``: language, quality, near-duplicates, personal data, packing.

Every stage takes the documents that the stage before it kept, all columns with them, and its
decisions take effect. The last stage returns packed pieces. Null and empty texts have no
language and go in the first stage; repeated rows count as copies and all but one go in the third.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, neardup, packing, pii, quality
from ledgerloom.llm.common import scratch, shared_dir, table
from ledgerloom.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters, and texts whose words fit no learned language, go."""
    return langid.keep_identified(docs, langid.train(docs, langid.training_rows()))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least a half."""
    stats = scratch(quality.document_statistics(docs), "statistics")
    model = quality.train(stats, table(spark, sf_dir, "labels"), usable=quality.training_rows())
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id."""
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its sequence and place in it."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet and read again by the next."""
    docs, run_id = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{run_id}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
