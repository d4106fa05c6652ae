"""Streams: a pool scored over a stream, and the event log consumed in batches.

Neither needs a watermark: scoring keeps no state, and the log is grouped by
class within each batch of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from votelake.operators.annotators import Annotator, run_pool

EVENTS = "iter int, type string, name string, target_class int, reason string, snippet string, class int, f1 double"


def score_stream(examples: DataFrame, pool: list[Annotator], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Votes of a streaming table of examples, appended as Parquet exactly once."""
    writer = run_pool(examples, pool).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def consume_events(spark: SparkSession, log: str, out: str, checkpoint: str) -> StreamingQuery:
    """New files of the event log, counted by class and type; a batch overwrites its own partition, so a retry does no harm."""
    events = spark.readStream.schema(EVENTS).json(log)

    def lessons(batch: DataFrame, number: int) -> None:
        by = F.coalesce("target_class", "class").alias("target")
        grouped = batch.groupBy(by, "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max(F.struct("iter", "f1"))["f1"].alias("last_f1"))
        grouped.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(lessons).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lessons_by_class(events: DataFrame, recent_events: int = 15, recent_scores: int = 8) -> tuple[DataFrame, DataFrame]:
    """The last dropped annotators and the last F1 values of each class."""
    from votelake.operators.analyze import last_per_key

    dropped = events.filter("type <> 'class_f1'").withColumn("key", F.col("target_class"))
    scores = events.filter("type = 'class_f1'").withColumn("key", F.col("class"))
    return last_per_key(dropped, "key", F.struct("iter", "name"), recent_events), last_per_key(scores, "key", F.col("iter"), recent_scores)
