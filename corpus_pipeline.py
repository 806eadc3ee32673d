"""From raw documents to packed sequences, in five stages; each but the last returns the columns of ``documents``.

1. ``quality``: documents that the quality classifier predicts to be bad go.
2. ``language``: documents without a letter, of no clear language or of another language than stated go.
3. ``lines``: long lines that three or more documents hold stay in one of them only; documents stay, even if left empty.
4. ``near_duplicates``: of documents with word 5-shingles of similarity 0.8 or more, the one with the smallest id stays.
5. ``packing``: the rest is packed into sequences of 2048 tokens; one row per piece.

Cases. Empty tables give empty results. Null and empty texts go in the second stage, having no letter, if the first lets them pass. Repeated rows are one in the fourth;
so are ties of documents that are near each other, by the smallest id. Rows without an id take part in all stages but the fourth, which keeps them. Long texts pass whole. Extra
columns pass through the first, second and fourth stage, whatever their names, and go in the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import langid, quality
from knotwork.llm.common import table
from knotwork.llm.line_dedup import dedup_lines
from knotwork.llm.near_dup import drop_near_duplicates
from knotwork.llm.packing import pack
from knotwork.plans.storage import Table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.train(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifiers' predictions can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as own:  # what a stage writes on its way goes when its result is written, and so does the result before it
            after = own.keep(Table(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
