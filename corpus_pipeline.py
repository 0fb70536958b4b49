"""The corpus pipeline: from `documents` to packed training sequences.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Each stage works on
all that its predecessor kept, and fits its model on those rows.

Defined cases: rows are judged by their own text, so rows that share an id, or have none, don't share their fate in the
two filters; further columns are carried through up to packing, which returns its own; an empty table gives an empty
result of every stage. What null and empty texts get is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refsift.llm import exact_dedup, language_id, near_dedup, packing, quality
from refsift.llm.common import Workspace, table
from refsift.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or unlike every learned language, go; without any labelled
    row no language is known and all go."""
    return language_id.keep(docs, language_id.fit(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of low quality go, null and empty texts among them."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of null, empty and blank texts too."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays; texts without words are in no group, nor are rows without
    an id."""
    return near_dedup.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is one id."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.cut(stage(spark, docs, sf_dir), name)
    return docs
