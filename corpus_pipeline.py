"""A training-data pipeline over documents: five stages, each an operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fresh_path, remove, scratch, table
from spanloom.llm.decontaminate import clean_documents
from spanloom.llm.line_dedup import cut_lines
from spanloom.llm.near_dedup import keep_one
from spanloom.llm.quality import accepted
from spanloom.llm.sentencepiece_codec import encode_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Null and empty texts stay; repeated rows stay or go together; rows with null ids are judged by their
    text; an empty table stays empty, and columns named like the operator's scores stay as they are."""
    return accepted(docs, labels=table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines; n_chars is that of what is left where lines went. Null texts stay null; a document whose lines all go stays, empty; of lines that
    several documents begin with, the least id's stays, and repeated rows keep it alike; an empty table stays empty."""
    return cut_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, of the least id. Null and empty texts are one class; rows with null ids all stay; of repeated rows one stays; different texts
    of one id are documents of their own; an empty table stays empty."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark. Null and empty texts stay, as do rows with null ids unless their text is contaminated; repeated rows stay or
    go together; without documents or items nothing goes."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: doc_id, n_tokens and ids. Null and empty texts have none; every row, repeated or with a null id, has its own; an empty table stays empty."""
    return encode_texts(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL expresses neither the classifier nor the codec; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again. A stage's working tables go when its
    result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
