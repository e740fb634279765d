"""From raw documents to token ids, in five stages.

1. toxicity: documents that the classifier chain rejects go.
2. line dedup: lines that repeat an earlier line go, and documents of which nothing is left.
3. near dedup: of each group of near-duplicates the smallest id stays.
4. decontamination: documents that share a long span with a benchmark item go.
5. tokens: the remaining texts as piece ids, with the decoding checked.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the
last return the columns of documents. Rows with null texts pass all filters and
get null ids; rows with null ids are never near-duplicates. Repeated rows (equal
ids) are reduced to one by the third stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, linededup, neardup, sentencepieces, toxicity
from factloom.session import cut, ensure_importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def strip_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return linededup.strip_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return neardup.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return sentencepieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", strip_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", to_tokens),
]

#: The classifiers' numerical fit isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read from there by the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
