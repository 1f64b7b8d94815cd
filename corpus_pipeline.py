"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as
Parquet and rereads it as the next one's docs.  All but the last return the columns of
``documents``.  SQL cannot express the stages (see the tests for brute-force versions).

null, empty and short texts fail the quality rules and go there; very long texts take the
same path as others, whole.  Rows that repeat, and rows of one id, are judged alike and share
their document's fate; a row with a null id is no one's copy and keeps its lines, but may be
rejected or contaminated like others.  An empty table passes through empty, and columns
besides the id and the text, whatever their names, stay with their rows to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.llm import bpe, common, decontaminate, lines, neardup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go from the texts; n_chars follows."""
    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, common.read(spark, sf_dir, "benchmark"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens): ids as little-endian uint32."""
    out = bpe.encode(docs, bpe.word_vocabulary_path())
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_ids", bpe_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
