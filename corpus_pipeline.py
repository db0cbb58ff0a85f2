"""The corpus pipeline: documents in, token ids out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). All stages but the last keep the columns of docs, whatever their names and types. run() writes each stage's rows as Parquet into the shared folder and gives the next stage what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode
from tidemark.llm.decontam import clean_documents
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dup import keep_one
from tidemark.llm.toxicity import drop_toxic, labelled
from tidemark.session import stored, table, work_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go. Null and empty texts are scored as texts without signs and stay; rows that are alike share their fate; without labels of both classes every document stays; an empty table gives an empty one."""
    return drop_toxic(docs, docs, labelled(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first copy of each line stays, in order of doc_id (null first), text hash and line. Null and empty texts stay as they are; repeated rows are one document and all stay, with the same lines; a document that loses its every line goes; an empty table gives an empty one."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the least doc_id. Documents without words and rows without a doc_id stay; of repeated rows one stays; an empty table gives an empty one."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go. Null and empty texts and rows without a doc_id stay; rows that share a doc_id share their fate; an empty benchmark leaves every document; an empty table gives an empty one."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for every document that is left. A null text has null tokens, an empty one none; each row gives its own; an empty table gives an empty one."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for the documents of sf_dir."""
    work, docs = work_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{work}/{k}-{name}")
    return docs
