"""Sinks: JSON lines, documents, manifests, labelled rows, label dumps, pools, event logs; resume by artifact."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.operators.aggregate import stored_or_majority
from votelake.operators.labelmodel import decide
from votelake.sources.readers import exists


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small result (a report, a brief) as one JSON document: its rows in an array."""
    rows = [json.loads(r[0]) for r in df.limit(100_001).select(F.to_json(F.struct("*"))).collect()]
    if len(rows) > 100_000:
        raise ValueError("documents hold at most 100,000 rows; write a table instead")
    text = json.dumps(rows, ensure_ascii=False, indent=1)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def manifest(examples: DataFrame) -> DataFrame:
    """(split, label, n) and mean number of labels by split, 3 places."""
    labels = examples.select("split", F.explode_outer("true_labels").alias("label")).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    mean = examples.groupBy("split").agg(F.round(F.avg(F.size("true_labels")), 3).alias("mean_labels"), F.count(F.lit(1)).alias("rows"))
    return labels.join(mean, "split")


def labeled_rows(examples: DataFrame, votes: DataFrame, aggregated: dict[str, DataFrame], pool: list[str] | None = None) -> DataFrame:
    """The rows of examples with votes as a map and aggregated_labels as a struct.

    With ``pool`` the map names every annotator, -1 for abstain.
    """
    from votelake.operators.annotators import vote_map

    wide = vote_map(examples, votes, pool) if pool else votes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lf", "vote"))).alias("votes"))
    out = examples.join(wide, "id", "left")
    for name, labels in aggregated.items():
        column = "labels" if "labels" in labels.columns else "label"
        out = out.join(labels.select("id", F.col(column).alias(f"__{name}")), "id", "left")
    return out.withColumn("aggregated_labels", F.struct(*[F.col(f"__{n}").alias(n) for n in aggregated])).drop(*[f"__{n}" for n in aggregated])


def dump_labels(labeled: DataFrame, proba: DataFrame, name: str, multi_label: bool = False, threshold: float = 0.5) -> DataFrame:
    """Sets majority_vote, weighted_vote and ``name`` from a model (single label), or adds ``name`` and its probabilities."""
    d = decide(proba, multi_label, threshold)
    met = labeled.join(d.drop("split"), "id", "left")
    if multi_label:
        return met.withColumn("aggregated_labels", F.col("aggregated_labels").withField(name, F.col("labels"))).withColumnRenamed("proba", f"{name}_proba").drop("labels")
    agg = F.col("aggregated_labels")
    for field in ("majority_vote", "weighted_vote", name):
        agg = agg.withField(field, F.col("label"))
    return met.withColumn("aggregated_labels", agg).drop("label", "proba")


def dump_majority(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The stored majority label where there is one, abstain included; mirrored to weighted_vote."""
    return stored_or_majority(stored, recomputed).select("id", "split", F.col("label").alias("majority_vote"), F.col("label").alias("weighted_vote"))


def write_probabilities(proba: DataFrame, path: str) -> None:
    proba.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file at ``path``, replaced; for small texts of the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def pool_source(blocks: list[str], names: list[str], comment: str = "") -> str:
    """Source of a pool module: each block once, in order, then the ANNOTATORS list of the names that begin with lf_."""
    kept = dict.fromkeys(b.rstrip() for b in blocks if b and b.strip())
    listed = "".join(f"    {n},\n" for n in names if n.startswith("lf_"))
    head = [f"# {line}" for line in comment.splitlines()] + ["ABSTAIN = -1"]
    return "\n\n".join(["\n".join(head), *kept, f"ANNOTATORS = [\n{listed}]\n"])


def write_pool(spark: SparkSession, blocks: list[str], names: list[str], path: str, comment: str = "") -> None:
    _write_text(spark, path, pool_source(blocks, names, comment))


def write_embeddings(embedded: DataFrame, path: str, model: str) -> None:
    """Embedding cache: id as string, split, emb as floats (not normalised) and the model's name."""
    embedded.select(F.col("id").cast("string").alias("id"), "split", F.col("emb").cast("array<float>").alias("emb"), F.lit(model).alias("model")).write.mode("overwrite").parquet(path)


def write_enriched(spark: SparkSession, source: str, target: str, enrich, features: list[str], splits: tuple[str, ...] = ("train", "val", "test"), side: tuple[str, ...] = ("dataset.json", "label_map.json")) -> list[str]:  # noqa: ANN001
    """Enriched copies of the splits that exist, side files as they are, then a marker that names source and features.

    The marker is written last, so its presence means a whole copy.  Returns the splits written.
    """
    done = []
    for s in splits:
        if exists(spark, f"{source}/{s}.jsonl"):
            write_jsonl(enrich(spark.read.json(f"{source}/{s}.jsonl")), f"{target}/{s}.jsonl")
            done.append(s)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name in side:
        if exists(spark, f"{source}/{name}"):
            a, b = hadoop.Path(f"{source}/{name}"), hadoop.Path(f"{target}/{name}")
            hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    _write_text(spark, f"{target}/.enriched_features.json", json.dumps({"source": source, "features": features, "splits": done}, indent=1))
    return done


def append_events(events: DataFrame, path: str) -> None:
    """Adds to the event log."""
    events.write.mode("append").json(path)


def archive_events(spark: SparkSession, path: str, archive: str, period: int) -> None:
    """Moves the log to a period's partition: it is renamed first, so events appended meanwhile start a new log.

    A call after a failure takes up the renamed log of that period; events that
    came since stay for the next period.
    """
    aside = f"{path}.period={period}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not exists(spark, aside):
        if not exists(spark, path):
            return
        fs.rename(hadoop.Path(path), hadoop.Path(aside))
    spark.read.json(aside).write.mode("overwrite").json(f"{archive}/period={period}")
    fs.delete(hadoop.Path(aside), True)


def resume(spark: SparkSession, path: str, build) -> DataFrame:  # noqa: ANN001
    """Reads the table at ``path`` if a finished write left one, else builds and writes it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
