"""A cleaning pipeline over the table documents: five stages, each one operator of plumbline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it back as the next stage's documents. All stages but the last
return the columns of documents, whatever other columns there are and whatever their names. Every
stage judges repeated rows alike, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, language_id, line_dedup, piece_scan
from plumbline.llm.columns import free_names
from plumbline.session import written


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells, with that language in ``lang``.

    Texts that are null, empty or without a letter go, as do those whose best language scores under
    ``language_id.MIN_SCORE`` and those whose ``lang`` the network contradicts without being sure
    (``language_id.SURE``); where it is sure, its language replaces ``lang``. Without any row to learn from
    all go, for nothing can be told.
    """
    return language_id.identified(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sources share; ``n_chars`` follows a changed text.

    A null or empty text stays as it is; a text of such lines alone becomes empty and keeps its row.
    """
    lines, gone = free_names(docs.columns, "lines", "gone")
    out = line_dedup.remove_boilerplate(docs, counts=(lines, gone))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of equal or similar texts.

    Texts without words resemble nothing and stay, as do rows without an id; rows that share the id of
    a document that stays, stay with it.
    """
    return jaccard_join.one_of_each_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and short texts contain none."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text (little-endian unsigned 32-bit), their number and score; a null or empty
    text has none."""
    return piece_scan.encode(docs).select("doc_id", "n_pieces", "score", "ids")


STAGES = [
    ("language_id", with_language),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", as_pieces),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
