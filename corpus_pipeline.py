"""The corpus pipeline: toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every
result is written as Parquet in the shared folder and read again as the next one's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyforge.llm import exact_dedup, near_dedup, packing, toxicity
from plyforge.llm.common import staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted on the labelled ones predicts to be toxic go."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.without_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL has neither the compressor nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
