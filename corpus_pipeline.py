"""The corpus pipeline: toxic texts go, copies go, near copies go, sources are mixed, the rest is packed.

Null texts count as empty; null ids, ties and repeated rows are treated as each operator says;
columns of any name pass through all stages but the last. Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but
the last return the columns of documents. Texts are whole throughout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import exact_dedup, mixing, near_copies, packing, toxicity
from verdictlake.llm.rows import table
from verdictlake.scale import bounded_batches, shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below one half; labels are learnt from training folds only."""
    return toxicity.drop_toxic(docs, table(bounded_batches(spark), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the largest id, of every group of equal texts."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of every group linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    bounded_batches(spark)
    return near_copies.keep_one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to two times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    bounded_batches(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# Compression lengths, shingle sets and tokens are not SQL. Tests compare the operators of exact_dedup, near_dedup and mixing with
# brute force or SQL; toxicity is tested on planted texts, and run() as a whole for its columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
