"""Shared pieces: the shared work folder, materialised tables, skew-safe joins
and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that every contract of this sub-package names.
SPACE = r"\x20\x09-\x0D"

#: A key is hot when it holds more than this share of all rows, so there are fewer hot keys than 1/share.
HOT_SHARE = 0.001
#: Keys with fewer rows than this are never hot.
HOT_ROWS = 500
#: Rows that a Python worker gets at once while a table is written; texts may be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders of materialised tables, oldest first.
_written: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new sub-folder of ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a temporary folder is taken, but only in
    local mode (tests); a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="votelake-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/votelake-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without touching a configured folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_folder(spark))


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors never cause the upstream work to be done
    again, and later passes read only the columns they need.
    """
    path, spark = folder or work_folder(df.sparkSession), df.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS)))
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if not folder:
        _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Where rows of a table are numbered; names that begin with ``__vl_`` are reserved in all inputs of this sub-package.
ROW = "__vl_row"
#: Row numbers that are broadcast at most, so that the driver's part is the same at any size; with more, both sides are shuffled by the number, which has no hot value.
MOST_NUMBERS = 200_000


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number each in ``ROW``, on which every later pass agrees.

    That is doc_id where it names each row (none is null or repeated), so
    nothing is written; else the rows are numbered and written once.
    """
    if dict(rows.dtypes).get("doc_id") in ("int", "bigint"):
        unclear = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
        if unclear.isEmpty():
            return rows.withColumn(ROW, F.col("doc_id").cast("long"))
    return materialize(rows.withColumn(ROW, F.monotonically_increasing_id()))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled at any size: tables that grow with the corpus never go through the driver."""
    return df.hint("merge")


def by_number(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of ``numbered`` rows with the ``ROW`` column of ``numbers``."""
    listed = materialize(numbers.select(F.col(ROW).alias("__vl_listed")))
    listed = F.broadcast(listed) if listed.count() <= MOST_NUMBERS else shuffled(listed)
    return rows.join(listed, F.col(ROW) == F.col("__vl_listed"), how)


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose number is not in ``gone``, in their own columns."""
    return by_number(rows, gone, "left_anti").drop(ROW)


def mark() -> int:
    """A point in time for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int, *but: DataFrame) -> None:
    """Delete the tables materialised after ``since`` that none of ``but`` reads."""
    used = {f.rsplit("/", 2)[-2] for df in but for f in df.inputFiles()}
    for path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in used:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[since:] = [p for p in _written[since:] if p.rsplit("/", 1)[-1] in used]


def attach_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """Inner-join ``rows`` to ``per_key`` (one row a key, ``count`` rows of ``rows`` each).

    Keys holding over ``HOT_SHARE`` of all rows number fewer than ``1/HOT_SHARE``
    whatever the input, so those are broadcast; their rows then carry a spread
    key through the shuffle join of the rest, and no task gets a whole hot key.
    ``rows`` is passed once.  ``key`` is a string column that is never null;
    ``per_key`` should be materialised.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    values = [c for c in per_key.columns if c != key]
    hot = per_key.filter(F.col(count) > limit).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hot"))
    cold = per_key.filter(F.col(count) <= limit).select(F.col(key).alias("__ck"), F.struct(*values).alias("__cold"))
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    tagged = tagged.withColumn("__jk", F.when(F.col("__hk").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), (F.abs(F.hash(spread)) % 4096).cast("string"))))
    joined = tagged.join(cold, F.col("__jk") == F.col("__ck"), "left")
    found = F.coalesce("__hot", "__cold")
    return joined.filter(found.isNotNull()).select(*rows.columns, *[found[v].alias(v) for v in values])


def spread_hash(*cols: Column) -> Column:
    """31 uniform bits of the given columns as text, for orders that ignore meaning."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.shiftright(F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long"), 1)


def bucket_count(rows: int) -> int:
    """Buckets a group for running totals: about 200,000 rows each at any size."""
    n = 256
    while n * 200_000 < rows:
        n *= 2
    return n


def running_total(rows: DataFrame, group: str, order: str, ties: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Exclusive running total of ``value`` within ``group``, by ``order`` then ``ties``.

    ``order`` holds 31 uniform bits.  Rows are cut into ``buckets`` ranges of
    it; the totals of ranges (a small table) give each range its start, and a
    window within the range does the rest, so a hot group is spread over
    ``buckets`` tasks.  ``rows`` should be materialised: it is read twice.
    """
    cut = rows.withColumn("__b", F.shiftright(F.col(order) * F.lit(buckets).cast("long"), 31).cast("int"))
    sums = cut.groupBy(group, "__b").agg(F.sum(value).alias("__v"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("__g"), F.col("__b").alias("__gb"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")))
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__b", "__g", "__gb", "__start")
    )
