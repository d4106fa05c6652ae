"""Texts for a language model: task briefs, clusters to work on, lessons from dropped annotators.

The parts that hold data are Column expressions; only a task's fixed text is made on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.analyze import last_per_key
from votelake.schema import Task

CLUSTERS, EXAMPLES, WORDS = 6, 6, 10

#: What an annotator should look at, by the family of its task.
GUIDES = {
    "classification": "Look for words, phrases and formats that one class has and the others lack. Combine at least two of them.",
    "verification": "Compare the claim with the evidence: shared words, numbers, negation. A claim and its evidence that merely share a topic prove nothing.",
}


def guide(task: Task) -> str:
    return GUIDES[task.family]


def task_brief(task: Task, seeds: str = "", extra: str = "") -> str:
    """Classes by id, their guardrails, the fields a rule may read, seed examples and the family's guide."""
    parts = [
        f"Write annotators that answer: {task.description}.",
        "Classes:\n" + "\n".join(f"  {i} = {n}" for i, n in enumerate(task.classes)),
    ]
    if task.guardrails:
        parts.append("\n".join(f"[{task.classes[c]}] {t}" for c, t in sorted(task.guardrails.items())))
    parts.append("Fields: text, num_words" + "".join(f", {f}" for f in task.bool_features))
    parts.append("An annotator takes one row and returns a class id, or -1 to abstain.")
    parts += [p for p in (f"Examples:\n{seeds}" if seeds else "", guide(task), extra) if p]
    return "\n\n".join(parts)


def class_name(task: Task, c: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in task.classes]), c), F.lit("?"))


def render_clusters(summary: DataFrame, words: DataFrame, examples: DataFrame, task: Task) -> DataFrame:
    """(position, text) of the clusters of most mass, at most 6, with 10 words and 6 examples of 300 characters each.

    summary(center, mass, target_label), words(group, word, rank) and
    examples(center, rank, text) as ``analyze.clusters`` and ``cluster_keywords`` give them.
    """
    from pyspark.sql import Window

    top = summary.orderBy(F.desc("mass"), "center").limit(CLUSTERS)
    # six rows
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mass"), "center")))
    listed = lambda rows, by, k, text: rows.filter(F.col("rank") <= k).groupBy(F.col(by).alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]).alias("x"))
    said = listed(words, "group", WORDS, F.col("word")).withColumnRenamed("x", "__w")
    shown = listed(examples, "center", EXAMPLES, F.concat(F.lit("  - "), tx.shortened(F.col("text")))).withColumnRenamed("x", "__e")
    met = top.join(said, "center", "left").join(shown, "center", "left")
    head = F.when(F.col("target_label").isNull(), F.concat(F.lit("Cluster "), F.col("position"), F.lit(": mostly without votes"))).otherwise(
        F.concat(F.lit("Cluster "), F.col("position"), F.lit(": class "), F.col("target_label"), F.lit(" ("), class_name(task, F.col("target_label")), F.lit(")"))
    )
    line = F.when(F.size("__w") > 0, F.concat(F.lit("words: "), F.array_join("__w", ", ")))
    return met.select("position", F.concat_ws("\n", head, line, F.array_join("__e", "\n")).alias("text"))


def improver_brief(task: Task, clusters: str, taken: list[str]) -> str:
    """The whole text of an improvement round; ``taken`` are names not to use again."""
    asked = clusters or "No cluster stands out; write rules for all classes."
    return task_brief(task, extra=f"Work on these groups of examples:\n{asked}\n\nNames in use: {', '.join(sorted(taken)) or 'none'}")


def reflection_texts(dropped: DataFrame, scores: DataFrame, events: int = 15, points: int = 8) -> DataFrame:
    """(class, n_events, text): the last dropped annotators of each class and the last points of its F1.

    dropped(seq, class, name, iter, reason), scores(seq, class, f1); both by rising seq.
    """
    n = dropped.groupBy("class").agg(F.count(F.lit(1)).alias("n_events"))
    line = F.concat(F.col("name"), F.lit(" (round "), F.col("iter").cast("string"), F.lit("): "), F.col("reason"))
    last = last_per_key(dropped, "class", F.col("seq"), events).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    path = last_per_key(scores, "class", F.col("seq"), points).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "f1"))), lambda x: F.format_string("%.3f", x["f1"])), ", ").alias("path"))
    met = n.join(last, "class").join(path, "class", "left")
    return met.select("class", "n_events", F.concat(F.lit("F1: "), F.coalesce("path", F.lit("no data")), F.lit("\n"), F.col("lines")).alias("text"))


def keep_lessons(lessons: DataFrame, f1: DataFrame, limit_tokens: int = 2000, verbatim: int = 3) -> DataFrame:
    """(class, lesson, keep): lessons cut to four sentences; once all together pass the token estimate, only those of the lowest F1 are kept verbatim.

    lessons(class, lesson), f1(class, f1); the others (keep false) go to a model that merges them.
    """
    from pyspark.sql import Window

    cut = lessons.withColumn("lesson", tx.first_sentences(tx.fenced_block(F.col("lesson")), 4)).join(f1, "class", "left")
    # one row a class
    total = F.sum(tx.token_estimate(F.col("lesson"))).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.coalesce("f1", F.lit(0.0)), "class"))
    return cut.withColumn("keep", (total <= limit_tokens) | (rank <= verbatim)).select("class", "lesson", "keep")
