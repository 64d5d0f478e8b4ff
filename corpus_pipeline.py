"""Documents made ready for training, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from growthpanel.llm import mixing, packing, secret_scan, simhash, toxicity
from growthpanel.llm.shared import delete_path, shared_folder, shelves_cleared, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the scorer learns from those of the labelled rows that are in ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that fingerprints within two bits connect, the document with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by the kind of secret."""
    return secret_scan.mask_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: learned scores, fingerprints by XXH64 and packing have no SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next one.

    When a stage is written, the tables it worked with and the stage before it are deleted. An empty table of documents
    gives no pieces; nulls, repeated rows and further columns are treated as each stage's function says.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        with shelves_cleared():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return docs
