"""From raw documents to a tokenised training mix, each stage one of the operators.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that the next one reads. All but the last return the
columns of documents. Rows come with whatever doc_ids the documents have; each stage's handling of nulls, ties and repeated
rows is that of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import bpe, line_dedup, mixing, near_dedup, quality
from pactum.llm.queries import VOCABULARY, table
from pactum.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict is per row, from its text, so no join is needed."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat others."""
    return line_dedup.line_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows with one doc_id are one document and all stay or go."""
    gone = stored(near_dedup.near_dedup(docs).where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, none to twice."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): each document of the mix as tokens."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier, the fuzzy lines, the balanced draws and the tokens have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
