"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share the words of the whole corpus by weight, none above
``MAX_REPEATS`` times its own; what is over goes to the others by weight (a
water level found in one pass over the sources).

Schedule: source s has the weight w_s(t) = w_s * (1 + slope_s * (2t - 1)) over
training time t in [0, 1].  Its integral is W_s(t) = w_s * (t + slope_s * (t^2 - t)),
so by time t the mix asks target_s * W_s(t) / w_s words of it.  A document that
begins after c words of its source is due at the t where that demand reaches
c: a quadratic, inverted in closed form.  Documents of a source stand in an
order by hash; a source asked for r times its size is gone through r times,
the last time in part, and the document at the end is cut there.

Edge cases: null text counts no words, takes none and is placed with its
source; null source is a source, last in order; rows of equal hash are ties,
in order of doc_id and size; repeated rows are taken like others; texts of any
length are counted whole and never cut; other columns, whatever their names
(but for ``__vl_``), are kept by ``mix``; an all-empty or empty table takes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votelake.llm.common import SPACE, bucket_count, materialize, running_total, spread_hash

MAX_REPEATS = 3
#: Hash ranges of all sources together that are broadcast, about 100 bytes each; with more, rows are joined by (source, range), of which none is hot.
MOST_RANGES = 200_000
#: Words that a partition of the training stream holds about.
PART_WORDS = 20_000_000
#: Rows that a range of the query's positions holds about.
PART_ROWS = 500_000


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight, slope and target to one row a source with its source_size.

    One row a source goes through two windows without a partition; there are
    as many rows as sources, never as documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("k", F.row_number().over(by_name)).withColumn("weight", ((F.col("k") - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("slope", ((F.col("k") % 3) - 1).cast("double") * 0.5).withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # sources fill up in the order of cap / weight; the first that the level leaves free fixes it for all after it
    leveled = ranked.withColumn("lv", level).withColumn("free", F.col("lv") * F.col("weight") <= F.col("cap"))
    final = leveled.withColumn("fixed", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col("lv")))).over(everything)["lv"])
    return final.select("source", "source_size", "weight", "slope", F.coalesce(F.least("cap", F.col("fixed") * F.col("weight")), F.col("cap")).alias("target"))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position and offset for every row.

    ``position`` in [0, 1] is when the row is first due (null if never),
    ``word_offset`` the words of its source that stand before it.
    """
    rows = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread_hash(F.col("doc_id"), F.col("text")).alias("h"))
    )
    shares = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    run = running_total(rows, "source", "h", ["doc_id", "size"], "size", "word_offset", bucket_count(rows.count()))
    mixed = run.join(shares.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goal, whole, at = F.floor(F.col("target") + 0.5), F.col("source_size"), F.col("word_offset")
    taken = sum(
        (F.greatest(F.lit(0), F.least(F.col("size"), goal - whole * k - at)) for k in range(MAX_REPEATS)),
        F.lit(0).cast("long"),
    )
    mixed = mixed.withColumn("taken", F.when(whole > 0, taken).otherwise(F.lit(0)).cast("long"))
    return mixed.withColumn("position", F.when(F.col("taken") > 0, due(at, F.col("target"), F.col("slope"))))


def due(words: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``words``: the root of a*t^2 + (1-a)*t = words/target."""
    y = F.least(F.lit(1.0), words / F.when(target > 0, target))
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, y).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), root)))


def ranges_of(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """A row for each hash range of each source, with all that a row in it needs to know; ranges a source; words asked for.

    It holds where the range starts in the source's order and its words, and
    of the source its size, target, slope, how often it is gone through, and
    the last row that the last time still takes.  That row is found in two
    steps: the range in which the demand is used up (from range totals), then,
    in that one range of each source, the last row of which at least half is due.
    """
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread_hash(F.col("doc_id"), F.col("text")).alias("h")))
    ranges = bucket_count(rows.count())
    rows = rows.withColumn("b", hash_range(F.col("h"), ranges))
    sums = materialize(rows.groupBy("source", "b").agg(F.sum("size").alias("v")))
    shares = targets(sums.groupBy("source").agg(F.sum("v").alias("source_size")))
    goal = F.floor(F.col("target") + 0.5)
    shares = shares.withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(goal / F.col("source_size")))).otherwise(0).cast("int"))
    shares = materialize(shares.withColumn("rest", goal - F.col("rounds") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("v").over(before), F.lit(0)))
    starts = starts.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = materialize(starts.withColumn("at_end", (F.col("v") > 0) & (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("v"))))
    edge = starts.filter("at_end").select(F.col("source").alias("s"), F.col("b").alias("cut"), (F.col("rest") - F.col("start")).alias("left"))
    inside = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("cut"))).withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    due_half = (F.col("size") > 0) & ((F.col("left") - F.col("at")) * 2 >= F.col("size"))
    last = last.groupBy("source").agg(F.max("cut").alias("cut"), F.max(F.when(due_half, F.struct("h", "doc_id", "size"))).alias("last")).withColumnRenamed("source", "s")
    found = starts.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    found = materialize(found.select("source", "b", "start", "v", "source_size", "target", "slope", "rounds", "cut", "last"))
    asked = shares.agg(F.sum("target")).first()[0] or 0
    return found, ranges, int(asked)


def hash_range(h: Column, ranges: int) -> Column:
    return F.shiftright(h * F.lit(ranges).cast("long"), 31).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """The training stream: a row for each time a document is taken, in order of position.

    A row at the end of its source's share counts as taken if at least half of
    it is due; texts stay whole.  What a row needs to know of the corpus is
    one row of its hash range (``ranges_of``), so texts move once, to the
    partition of their position (twice, where there are too many ranges to
    broadcast).  Positions stand for hash ranges' exact words, and within a
    range of about 200,000 rows for the hash's place in it.
    """
    found, ranges, asked = ranges_of(docs)
    found = found.select(*[F.col(c).alias(f"__vl_{c}") for c in found.columns])
    keyed = docs.withColumn("__vl_size", word_count(F.col("text"))).withColumn("__vl_h", spread_hash(F.col("doc_id"), F.col("text"))).withColumn("__vl_at_b", hash_range(F.col("__vl_h"), ranges))
    small = found.count() <= MOST_RANGES
    joined = keyed.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("__vl_source")) & (F.col("__vl_at_b") == F.col("__vl_b")))
    extra = (F.col("__vl_b") < F.col("__vl_cut")) | ((F.col("__vl_b") == F.col("__vl_cut")) & F.coalesce(F.struct("__vl_h", "doc_id", "__vl_size") <= F.col("__vl_last"), F.lit(False)))
    n = F.when(F.col("__vl_size") > 0, F.col("__vl_rounds") + F.coalesce(extra, F.lit(False)).cast("int")).otherwise(0)
    each = joined.withColumn("__vl_n", n).filter("__vl_n > 0").withColumn("__vl_epoch", F.explode(F.sequence(F.lit(0), F.col("__vl_n") - 1)))
    place = F.col("__vl_h") * float(ranges) / float(1 << 31) - F.col("__vl_b")
    words = F.col("__vl_start") + place * F.col("__vl_v") + F.col("__vl_source_size") * F.col("__vl_epoch")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked // PART_WORDS)
    each = each.withColumn("__vl_at", due(words, F.col("__vl_target"), F.col("__vl_slope"))).select(*[docs[c] for c in docs.columns], "__vl_at", "__vl_h")
    part = F.least(F.lit(partitions - 1), F.floor(F.col("__vl_at") * partitions).cast("int"))
    return each.repartitionById(partitions, part).sortWithinPartitions("__vl_at", "__vl_h").drop("__vl_at", "__vl_h")


def by_position(mixed: DataFrame, rows: int) -> DataFrame:
    """The rows of ``plan`` in training order: a partition for each range of position, sorted within.

    Rows that are never due have no position; they stand in as many partitions
    after the others, dealt by hash.  ``rows`` is how many there are of both.
    """
    ranges = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS)
    due_in = F.least(F.lit(ranges - 1), F.floor(F.col("position") * ranges))
    never = ranges + F.pmod(F.xxhash64("h", "doc_id"), F.lit(ranges))
    part = F.when(F.col("position").isNull(), never).otherwise(due_in).cast("int")  # least() passes nulls over
    return mixed.repartitionById(2 * ranges, part).sortWithinPartitions("position", "h", "doc_id", "size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = by_position(plan(docs), docs.count())
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) >> 1 AS h FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, cast((k - 1) % 3 + 1 AS DOUBLE) AS weight, cast(k % 3 - 1 AS DOUBLE) * 0.5 AS slope, cast(source_size * 3 AS DOUBLE) AS cap FROM k),
l AS (SELECT *, (cast(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
      FROM w WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lv AS fixed FROM l WHERE lv * weight <= cap ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, source_size, slope, coalesce(least(cap, (SELECT fixed FROM f) * weight), cap) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, cast(floor(t.target + 0.5) AS BIGINT) AS goal,
        cast(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least(size, goal - a)) + greatest(0, least(size, goal - source_size - a)) + greatest(0, least(size, goal - 2 * source_size - a)) ELSE 0 END AS taken,
        least(1.0::DOUBLE, a / CASE WHEN target > 0 THEN target END) AS y FROM m)
SELECT doc_id, size, source_size, target, cast(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN y ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope))) END END AS position
FROM x
"""
