"""The corpus pipeline: five stages over ``documents``, each kept as Parquet.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever other columns those have (names
that begin with ``__vl_`` are reserved).  A table that a stage has written for
itself is deleted when the stage's result is kept.

Edge cases, for every stage: an empty table gives no rows; texts of any length
are read whole; nulls in any column are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votelake.llm import bpe, common, exact_dedup, mixing, simhash, similar, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts score 0 and stay; equal texts have equal scores, so
    repeated rows go or stay together; a score of the threshold goes.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays: the longest, then the least doc_id, null last, then the first row.

    Null counts as the empty text.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays; of these no two have 0.8 of their five-word shingles in common.

    The row of the least doc_id stays, null last, then the first row.  Texts
    without words have fingerprint 0 and are one component.
    """
    rows = common.numbered(docs)
    left = common.by_number(rows, simhash.copies(rows), "left_anti")
    return common.without_rows(left, similar.copies(left))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order.

    Null and empty texts have no words and are never taken; a null source is a
    source; repeated rows are taken like others.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them; a null text has no tokens."""
    return bpe.round_trip(docs, cache=80_000)  # workers keep the tables of the stages before, too


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Training of the toxicity model and the encoder are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        since = common.mark()
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.discard(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
