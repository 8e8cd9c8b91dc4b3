"""A corpus from raw documents to packed token sequences: quality, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. The stages are the operators of threadloom.llm with their production parameters. An empty table passes
through every stage; repeated rows are rows each, until the near duplicates; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.jaccard import one_of_each
from threadloom.llm.langid import fit, held_out, keep_confident
from threadloom.llm.packing import pack_documents
from threadloom.llm.repetition import keep_good
from threadloom.llm.shared import fresh, named, written
from threadloom.llm.substring import REPORT, remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; null texts and short ones are among them. All columns stay as they are."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose best language leads narrowly, go; a null lang is no label. All columns stay as they are."""
    return keep_confident(docs, fit(docs.where(~held_out()).select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest doc_id stays, one without an id only if all have none.

    Rows without words are linked with nothing and stay. All columns stay as they are.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a document of smaller doc_id has go (null: the greatest); n_chars follows the text.

    A document of which no word is left stays with an empty text. Other columns stay as they are.
    """
    report = fresh(docs.columns, *REPORT)
    cut = remove_repeats(docs, report=report)
    n_chars = F.when(F.col(report[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*named(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024; every row is packed, a null or empty text as one end id. Other columns go."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "spaces")


STAGES = [("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", packing)]

#: SQL can't express the language and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
