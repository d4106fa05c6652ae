"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes.  Two that differ in at
most ``BITS`` = 4 bits differ in at most four bytes, so they share at least
``SHARED`` = 4 positional bytes: the guaranteed minimum of the count filter.
Posting lists of single bytes would hold 1/256 of all rows each, and tallying
pairs in them grows with the square of the corpus.  So a posting list stands
for a few positions at once and the bytes found there.  Its positions are the
20 triples such that any four positions hold one of them (``triples``): pairs
that reach the minimum meet in a list, the shared bytes of all that meet are
tallied, pairs under the minimum go, and the rest are verified bit by bit.
From ``WIDE`` fingerprints on, lists are of four positions (all 70), as those
of three would hold too many by chance; either way no link is lost.

Only different fingerprints enter the index (copies share one row).  A posting
list of over ``LIST_ROWS`` fingerprints is not paired out.  Its members are
called crowded and linked through midpoints: two fingerprints differ in at
most 4 bits exactly if some value differs in at most 2 bits from both, so each
crowded one is sent to the 2081 values around it, and all that meet at a value
are tied to the least of them.  Every link lies in a short list, whose pairs
are verified, or in a long one, whose members are all crowded; so components
come out whole, and work is linear in the size of a group.  ``LIST_ROWS`` is
where both ways cost the same: 20 lists of 200 give a member 2000 pairs.

Components are found by alternating large and small stars, cut by
``checkpoint`` in the shared folder.

Edge cases: a null text has no words and, as an empty one, fingerprint 0,
linked like any other; a text with fewer words than a shingle is one shingle;
repeated shingles count each time; texts of any length are read whole, in
blocks of ``BLOCK`` shingles; rows with a null doc_id take part, and the
component takes the least doc_id that is not null (null if none is); repeated
rows are rows of their own; other columns, whatever their names (but for
``__vl_``), are not touched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm.common import ROW, attach_per_key, ensure_checkpoints, materialize, numbered, shuffled, without_rows

WORDS = 4
SEED = 42
BITS = 4
#: Positional bytes that two linked fingerprints share at least.
SHARED = 8 - BITS
#: Longest posting list whose pairs are formed; beyond it, 2081 midpoints a member cost less.
LIST_ROWS = 200
#: Fingerprints from which on posting lists are of four positions: a list of three then holds eight by chance.
WIDE = 1 << 27
#: Shingles hashed between two tallies, to bound memory on long texts.
BLOCK = 16_384


def fingerprint_of(data: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8 as an unsigned integer."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts, ends[words - 1 :], strict=False))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + BLOCK]], dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def fingerprint_batches(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                f = np.array([fingerprint_of(x or b"", words) for x in batch.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f.view(np.int64))], names=["doc_id", ROW, "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a row number (that of ``numbered`` rows) and fp, the fingerprint's bits as a signed long."""
    number = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number, F.encode(F.col("text"), "UTF-8").alias("data")).mapInArrow(
        fingerprint_batches(words), f"doc_id bigint, {ROW} bigint, fp bigint"
    )


def triples(n: int = 8) -> list[tuple[int, ...]]:
    """Triples of n positions such that any four positions hold one of them.

    Positions stand in three groups; a triple has all its positions in one
    group, or two in one and the third in the next.  Of four positions two
    share a group, and wherever the others are, one such triple is among them.
    """
    group = [3 * i // n for i in range(n)]
    inside = lambda t: {group[i] for i in t}
    fits = lambda t: len(inside(t)) == 1 or any(sorted(group[i] for i in t) == sorted([g, g, (g + 1) % 3]) for g in range(3))
    return [t for t in combinations(range(n), 3) if fits(t)]


def byte_of(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def index_keys(fp: Column, ways: list[tuple[int, ...]]) -> Column:
    """One key for each way to take positions: the way's number and the bytes."""
    keys = []
    for way, places in enumerate(ways):
        packed = F.lit(way).cast("long")
        for p in places:
            packed = F.shiftleft(packed, 8).bitwiseOR(byte_of(fp, p))
        keys.append(packed)
    return F.array(*keys)


def tally(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    return sum((F.when(byte_of(a.bitwiseXOR(b), i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def around(fp: Column) -> Column:
    """All values that differ from fp in at most two bits."""
    flips = [0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    return F.transform(F.lit(signed), lambda x: fp.bitwiseXOR(x))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints, each within reach, that connect all that any links connect.

    ``distinct`` has one column fp without repeats and should be materialised.
    """
    spark = distinct.sparkSession
    ways = triples() if distinct.count() < WIDE else list(combinations(range(8), SHARED))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = materialize(distinct.repartition(parts).select("fp", F.explode(index_keys(F.col("fp"), ways)).alias("key")))
    # most lists hold one; of those that hold two the pair is known from the count
    posting = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    twos = posting.filter("n = 2").select("a", "b")
    shared = materialize(keyed.join(shuffled(posting.filter("n > 2").select("key", "n")), "key"))
    short = shared.filter(F.col("n") <= LIST_ROWS).select("key", "fp")
    other = short.select("key", F.col("fp").alias("b"))
    met = twos.unionByName(short.withColumnRenamed("fp", "a").join(shuffled(other), "key").filter("a < b").select("a", "b"))
    pairs = met.filter(tally(F.col("a"), F.col("b")) >= SHARED).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).distinct()
    crowded = materialize(shared.filter(F.col("n") > LIST_ROWS).select("fp").distinct())
    near = crowded.select("fp", F.explode(around(F.col("fp"))).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "b")
    stars = near.join(shuffled(least), "mid").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node reachable) for every node of ``edges(a, b)``.

    Large and small stars in turn until nothing changes.  A round groups by
    node with map-side minima; no neighbour list is ever collected, and no
    table is broadcast, which in each round would go through the driver.
    """
    ensure_checkpoints(edges.sparkSession)
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(small), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = small.select("e.a", "e.b").filter("a != b").distinct().checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        last = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row number, fp, component_id and keep_row for every row.

    ``keep_row`` is the number of the component's first row: that of the least
    doc_id (null last), of several the least number.
    """
    prints = materialize(fingerprints(docs, words))
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(ROW).alias("r"))
    counted = materialize(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(counted.select("fp")))
    rooted = counted.join(shuffled(roots), counted["fp"] == roots["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("b")).select("root", F.col("b.d").alias("component_id"), F.col("b.r").alias("keep_row"))
    keyed = materialize(rooted.join(shuffled(firsts), "root").select(F.col("fp").cast("string").alias("fp"), "component_id", "keep_row", "rows"))
    rows = prints.select("doc_id", ROW, F.col("fp").cast("string").alias("fp"))
    return attach_per_key(rows, keyed, "fp", "rows", F.col(ROW)).select("doc_id", ROW, F.col("fp").cast("long").alias("fp"), "component_id", "keep_row")


def copies(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Numbers of the ``numbered`` rows that are not the first of their component."""
    return near_duplicates(rows, words).filter(F.col(ROW) != F.col("keep_row")).select(ROW)


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each component with all its columns: that of the least doc_id, rows without a doc_id last."""
    rows = numbered(docs)
    return without_rows(rows, copies(rows, words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
