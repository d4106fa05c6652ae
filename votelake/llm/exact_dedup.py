"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one
row a digest, sort-merge anti-joined with the index and what is new appended;
rows of known digests are copies of what the index already names, so none of
them is kept.

Edge cases: a null text counts as empty, and empty texts are equal to each
other; texts of any length are hashed whole.  A null doc_id loses to any
other.  Rows that agree in all of text, length and doc_id are ties; one of
them, whichever was read first, stays.  An empty table gives an empty result
and leaves the index as it was.  Other columns, whatever their names (but for
``__vl_``) and types, are not touched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm.common import ROW, SPACE, attach_per_key, materialize, numbered, without_rows, work_folder

BUCKETS = 64


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.encode(normalized(text), "UTF-8"), 256)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_points and a row number for ties (that of ``numbered`` rows); written once, as later passes must agree on it."""
    return materialize(
        docs.select(
            F.col("doc_id"),
            digest(F.col("text")).alias("digest"),
            F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
            (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias(ROW),
        )
    )


class DigestIndex:
    """``digest -> keep_id, group_size`` under ``location``, bucketed and sorted by digest.

    The same location may be opened again by a later session.  ``buckets`` is
    fixed when the index is made; take about one per 10 million digests.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.table = "votelake_digests_" + hashlib.md5(location.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> DataFrame:
        """Append the digests of ``batch`` (digest, keep_id, keep_row, rows) that are new, and return what holds for all of its digests.

        Known digests come with the index's keep_id and group_size and without a keep_row.
        """
        old = self.frame().select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
        known = F.col("old_size").isNotNull()
        met = batch.join(old.hint("merge"), "digest", "left").select(
            "digest",
            F.when(known, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(~known, F.col("keep_row")).alias("keep_row"),
            F.coalesce("old_size", "rows").alias("group_size"),
            "rows",
        )
        met = materialize(met)
        new = batch.join(self.frame().select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("keep_id"), F.col("rows").alias("group_size"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return met

    def forget(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def find_copies(docs: DataFrame, location: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """All rows with digest, keep_id, keep_row, group_size, rows (of this batch) and ``kept``.

    With no ``location`` the index is a new one, so ``group_size`` counts this
    table; with one, earlier batches decide first and ``group_size`` is that of
    the batch which brought the digest.  Hot digests are told by this batch's
    own rows.
    """
    signed = signatures(docs)
    rank = F.struct((-F.col("n_points")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(ROW).alias("r"))
    batch = signed.groupBy("digest").agg(F.min(rank).alias("b"), F.count(F.lit(1)).alias("rows"))
    batch = materialize(batch.select("digest", F.col("b.d").cast("long").alias("keep_id"), F.col("b.r").alias("keep_row"), "rows"))
    index = DigestIndex(docs.sparkSession, location or work_folder(docs.sparkSession), buckets)
    met = index.add(batch)
    if location is None:
        index.forget()
    return attach_per_key(signed, met, "digest", "rows", F.col(ROW)).withColumn("kept", F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(False)))


def drop_copies(docs: DataFrame, location: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns: an anti-join with the numbers of the rows that go."""
    rows = numbered(docs)
    return without_rows(rows, find_copies(rows, location).filter("not kept"))


QUERY_COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_copies(docs).withColumnRenamed("digest", "text_sha256").select(*QUERY_COLUMNS)


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
