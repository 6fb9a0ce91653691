"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of documents; the last one adds the token ids.
Null and empty texts go through all stages (of copies one stays); repeated rows are
judged alike, and the near-copy stage keeps one of them; a null doc_id is less
than all others; texts may be of any length; docs may have columns of any names
besides; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecframe.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from vecframe.llm.common import durable, ship, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity score is 0.5 or more."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines after their first place; every document stays."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group."""
    ship(spark)
    return simhash.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark text by the contract's rule."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, which go; ids and their count come after the other columns."""
    ship(spark)
    return pieces.tokens(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash_dedup", near_copies), ("decontamination", contaminated), ("sentencepiece", tokens)]

#: Stages 1, 3 and 5 (a fitted field, iterated components, a tokenizer) can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written once to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
