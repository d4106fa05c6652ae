"""Near-duplicates by the Jaccard similarity of word shingles, found exactly.

The second half of near-dedup: SimHash finds what is nearly equal, this finds
the rest of what shares ``LEAST`` of its shingles.  A text is the set of its
shingles of ``WORDS`` words (lower case, split at white space; a shorter text
is one shingle), each a 64-bit hash.  Two sets of similarity ``LEAST`` or more
share one of the first n - ceil(LEAST n) + 1 hashes of either in any common
order, so texts that share none of these prefixes are no pair, and all others
are candidates.  How many hashes of each set fall into each of ``CELLS`` cells
gives an upper bound of what two sets share, which ends most candidates; the
rest are verified on whole sets.  The order puts hashes that are frequent in a
sample last, which keeps posting lists short and, as any order will do, loses
nothing.

Candidates are met in posting lists, in rounds.  All pairs of a list of at
most ``LIST_ROWS`` texts are formed.  In a longer list all are compared with
one, its pivot; of each component found that way one text is left, the pivot
is done with, and what remains of the list comes again in the next round.  If
a round takes nothing out, the lists left hold texts that differ although they
share a hash, and their pairs are formed.  So no two texts that stay are
near-duplicates, and each that goes is tied to one that stays by a chain of
verified pairs.

Edge cases: null and empty texts are empty sets and near to none; texts that
differ only in case or white space are near; of a component the row of the
least doc_id stays (null last, of several the first row); texts of any length
are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import accumulate, islice
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.llm.common import ROW, by_number, materialize, shuffled
from votelake.llm.simhash import components

WORDS = 5
LEAST = Fraction(4, 5)
SEED = 42
#: Longest list whose pairs are formed at once.
LIST_ROWS = 64
#: Cells whose counts bound what two sets share; 2 bytes each and text.
CELLS = 256
#: About how many texts are sampled for frequent hashes, in how many of them a hash is frequent, and how many hashes are taken at most.
SAMPLE, FREQUENT, MOST = 5000, 5, 50_000


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    parts = data.lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(accumulate([len(p) + 1 for p in parts]))
    if len(parts) <= words:
        return np.array([digest(joined, SEED)] if parts else [], dtype=np.uint64).view(np.int64)
    spans = zip([0, *ends], ends[words - 1 :], strict=False)
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in spans], dtype=np.uint64).view(np.int64))


def prefix_size(n: int) -> int:
    return n - ceil(LEAST * n) + 1 if n else 0


def frequent(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes that are frequent in a sample."""
    step = max(1, rows.count() // SAMPLE)
    sample = sets_of(rows.filter(F.pmod(F.xxhash64(ROW), F.lit(step)) == 0), words)
    counted = sample.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r["h"] for r in counted.orderBy(F.desc("n"), "h").limit(MOST).collect()], dtype=np.int64))


def with_sets(rows: DataFrame, words: int, columns: dict[str, pa.DataType], schema: str, made: Callable[[np.ndarray], tuple]) -> DataFrame:
    """The number of each row and what ``made`` derives from its set."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for number, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield number, *made(shingles(data or b"", words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(batches)
        while part := list(islice(found, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), columns.values(), strict=True)], names=list(columns))
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no free memory

    return rows.select(ROW, F.encode("text", "UTF-8").alias("data")).mapInArrow(run, schema)


def prefixes(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """node (the row's number), the size of its set, the prefix of that, and how many of its hashes are in each cell."""
    last = frequent(rows, words)

    def made(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        late = np.isin(x, last)
        cells = np.bincount(x & (CELLS - 1), minlength=CELLS).astype(np.int32)
        return len(x), np.concatenate([x[~late], x[late]])[: prefix_size(len(x))], cells

    columns = {"node": pa.int64(), "size": pa.int64(), "prefix": pa.list_(pa.int64()), "cells": pa.list_(pa.int32())}
    return with_sets(rows, words, columns, "node bigint, size bigint, prefix array<bigint>, cells array<int>", made)


def sets_of(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """node and its whole set."""
    return with_sets(rows, words, {"node": pa.int64(), "set": pa.list_(pa.int64())}, "node bigint, set array<bigint>", lambda x: (x,))


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias(ROW)).union(pairs.select("b")).distinct()


def within_bound(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes (a, b) whose cells let them share enough."""
    cells = by_number(made.select(F.col("node").alias(ROW), "size", "cells"), nodes_of(pairs), "left_semi")
    met = pairs.join(shuffled(cells.toDF("a", "a_size", "x")), "a").join(shuffled(cells.toDF("b", "b_size", "y")), "b")
    most = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda s, n: s + n)
    return met.filter(most * (LEAST.denominator + LEAST.numerator) >= LEAST.numerator * (F.col("a_size") + F.col("b_size"))).select("a", "b")


def verified(rows: DataFrame, made: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of the pairs of nodes (a, b) that are near-duplicates; only texts within the bound are hashed again."""
    pairs = materialize(within_bound(made, materialize(pairs)))
    sets = materialize(sets_of(by_number(rows, nodes_of(pairs), "left_semi"), words))
    both = pairs.join(shuffled(sets.toDF("a", "x")), "a").join(shuffled(sets.toDF("b", "y")), "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    # n / union >= LEAST, in whole numbers
    return materialize(both.filter(F.col("n") * (LEAST.denominator + LEAST.numerator) >= LEAST.numerator * (F.size("x") + F.size("y"))).select("a", "b"))


def candidates(members: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes (a, b) that meet in the lists of members(h, node, size) and can reach ``LEAST``.

    What two sets share is counted in their lists, may be in the lists of
    ``long`` that both are in, or lies behind the prefix that ends first.
    """
    up, down = LEAST.numerator, LEAST.denominator
    m = members.select("h", "node", "size", F.lit(0).cast("long").alias("more"))
    if long is not None:
        more = long.groupBy("node").agg(F.count(F.lit(1)).alias("more"))
        m = members.select("h", "node", "size").join(shuffled(more), "node", "left").select("h", "node", "size", F.coalesce("more", F.lit(0)).alias("more"))
    met = m.toDF("h", "a", "a_size", "a_more").join(shuffled(m.toDF("h", "b", "b_size", "b_more")), "h").filter("a < b")
    met = met.filter(F.least("a_size", "b_size") * down >= F.greatest("a_size", "b_size") * up)
    met = met.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("a_size", "b_size", "a_more", "b_more")], F.count(F.lit(1)).alias("n"))
    behind = F.greatest(*[F.ceil(F.col(c) * up / down) - 1 for c in ("a_size", "b_size")]) + F.least("a_more", "b_more")
    return met.filter((F.col("n") + behind) * (up + down) >= (F.col("a_size") + F.col("b_size")) * up).select("a", "b")


def with_lists(members: DataFrame) -> DataFrame:
    """Members (h, node, size) of lists of two or more, with the list's length n and its pivot."""
    lists = materialize(members.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1"))
    return materialize(members.join(shuffled(lists), "h").select("h", "node", "size", "n", "pivot"))


def losers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of each component of ``edges`` but the one that stays."""
    found = materialize(components(edges).join(shuffled(ids), "node"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("node").alias("r"))
    stays = found.groupBy("root").agg(F.min(rank)["r"].alias("stays"))
    return materialize(found.join(shuffled(stays), "root").filter("node != stays").select("node"))


def copies(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Numbers of the ``numbered`` rows that go, so that no two of the rest are near-duplicates."""
    made = materialize(prefixes(rows, words))
    ids = rows.select(F.col(ROW).alias("node"), F.col("doc_id").cast("long").alias("doc_id"))
    members = with_lists(made.select(F.explode("prefix").alias("h"), "node", "size"))
    gone = made.select("node").limit(0)
    while True:
        short, long = members.filter(F.col("n") <= LIST_ROWS), members.filter(F.col("n") > LIST_ROWS)
        stars = long.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        edges = verified(rows, made, candidates(short, long).unionByName(stars).distinct(), words)
        found = not edges.isEmpty()
        if found:
            gone = materialize(gone.unionByName(losers(edges, ids)))
        if long.isEmpty():
            break
        rest = long.filter("node != pivot").select("h", "node", "size").join(shuffled(gone), "node", "left_anti")
        if not found:
            edges = verified(rows, made, candidates(rest), words)
            if not edges.isEmpty():
                gone = materialize(gone.unionByName(losers(edges, ids)))
            break
        members = with_lists(rest)
    return gone.select(F.col("node").alias(ROW))
