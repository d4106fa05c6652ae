"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard draws a score from (key, shard) alone: ``-ln(u) / weight`` with u
uniform from a hash.  The least score wins, so another shard takes rows only
into itself and a lost one gives its rows to all others by weight.  No row
looks at another: assignment is one projection without a shuffle.

Edge cases: a null text has no bytes (size 1, checksum 0); a null doc_id is a
key of its own and such rows share a shard; repeated rows share a shard and
get slots of their own; texts of any length are read whole; a shard of weight
0 takes no row, and weights that are all 0 or below 0 are an error; of equal
scores the lower shard wins; other columns, whatever their names (but for
``__vl_``), are not read by ``assign`` and kept by ``write_shards``; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm.common import bucket_count, materialize, running_total, spread_hash

SHARDS = 8


def uniform(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from the key and the shard's number: 52 bits of MD5."""
    hex13 = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def scores(key: Column, weights: list[float]) -> Column:
    """(score, shard) of each shard that has a weight, in order of shards."""
    if min(weights, default=0.0) < 0 or not any(weights):
        raise ValueError("weights must not be below 0, and one must be over 0")
    return F.array(*[F.struct((-F.ln(uniform(key, i)) / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w])


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard that wins the key; the lower number on a tie."""
    return F.array_min(scores(key, weights))["i"]


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard after one more, of the mean weight of those that have one, joins.

    Slots number a shard's rows from 0 without gaps, in an order by key hash.
    """
    live = [w for w in weights if w]
    grown = [*weights, sum(live) / max(1, len(live))]
    scored = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        scores(F.col(key), grown).alias("c"),
    )
    rows = scored.select(
        "doc_id",
        "size",
        "text_crc32",
        F.array_min(F.slice("c", 1, len(live)))["i"].alias("shard"),
        F.array_min("c")["i"].alias("grown_shard"),
    )
    rows = rows.withColumn("h", spread_hash(F.col("doc_id"), F.col("text_crc32"))).withColumn("one", F.lit(1).cast("long"))
    rows = materialize(rows)
    placed = running_total(rows, "shard", "h", ["doc_id", "text_crc32", "size"], "one", "slot", bucket_count(rows.count()))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float]) -> None:
    """Write the rows as one folder a shard (``__vl_shard=n``), all columns kept."""
    docs.withColumn("__vl_shard", rendezvous(F.col("doc_id"), weights)).write.partitionBy("__vl_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: With equal weights the least score is the largest hash; CRC-32 is a fold over bytes with a table made by its rule.
ORACLE = r"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
        list_transform(range(9), lambda i: cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), 'null') || ':' || cast(i AS VARCHAR)), 1, 13) AS BIGINT)) AS u FROM b, c),
s AS (SELECT doc_id, size, text_crc32, list_position(u[1:8], list_max(u[1:8])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard,
        cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || ':' || cast(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) >> 1 AS h FROM d)
SELECT doc_id, cast(size AS BIGINT) AS size, cast(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, cast(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, text_crc32, size) - 1 AS slot, cast(grown_shard AS INT) AS grown_shard FROM s
"""
