"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, packing.

Each stage works on all rows that the one before kept, and all but the last return the columns of documents. Defined results:
rows are judged one by one, by their text and id, so null and repeated ids take no other row along; null texts are empty texts;
an empty table gives an empty one; further columns stay as they are. Which stage keeps what is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import decontaminate, neardup, packing, quality
from dialoom.llm.common import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores 0.5 or more, empty and null ones too; without usable labels, all rows or none by
    the share of label 1."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.8 or more on five-word shingles: that with the smallest id. Rows
    without an id or without words stay, as nothing is linked with them; of rows that share id and text one stays."""
    return neardup.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too little of any benchmark item to count as contaminated; null and empty texts are clean."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontamination", keep_clean), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each to the rows that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
