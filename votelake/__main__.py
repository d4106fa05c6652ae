"""Command line: ``python -m votelake prepare | run | aggregate | evaluate | train | query``.

Tables are Parquet folders: examples(id, split, gold or labels, text, ...),
votes(id, split, lf, vote), labels(id, split, label).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from votelake.schema import get_task


def _shared(p: argparse.ArgumentParser, *tables: str, task: bool = True) -> None:
    """Arguments that several commands have: input tables, task, output."""
    for t in tables:
        p.add_argument(f"--{t}", required=True, help=f"Parquet folder of {t}")
    if task:
        p.add_argument("--task", required=True, help="name of a task")
    p.add_argument("--out", required=True, help="folder to write")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="votelake")
    p.add_argument("--master", help="Spark master; left to spark-submit by default")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("prepare", help="a dataset by its config to examples")
    c.add_argument("--config", required=True)
    c.add_argument("--out", required=True)
    c = sub.add_parser("run", help="evolve a pool of annotators on examples")
    _shared(c, "examples")
    c.add_argument("--iterations", type=int, default=3)
    c.add_argument("--per-round", type=int, default=6)
    c = sub.add_parser("aggregate", help="votes to labels")
    _shared(c, "examples", "votes")
    c.add_argument("--method", default="model")
    c.add_argument("--cache", help="embedding table")
    c.add_argument("--dim", type=int, default=0)
    c.add_argument("--folds", type=int, default=5)
    c = sub.add_parser("evaluate", help="scores of labels by split and by class, or of label sets")
    _shared(c, "examples", "labels")
    c = sub.add_parser("train", help="downstream classifiers on gold and weak labels, by size")
    _shared(c, "examples", "votes")
    c.add_argument("--sizes", type=int, nargs="+", default=[50, 200])
    c = sub.add_parser("query", help="a registered query over a folder of tables")
    c.add_argument("name")
    c.add_argument("--data", required=True)
    c.add_argument("--out", required=True)
    return p


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    from votelake.sources.readers import load_config
    from votelake.sources.readers import prepare as build

    _write(build(spark, load_config(a.config)), a.out)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the kept votes, the history and the annotators that were dropped."""
    from votelake.operators.providers import KeywordMiner
    from votelake.plans.loop import Evolution, Settings

    task = get_task(a.task)
    if task.multi_label:
        raise ValueError("the loop's gates need one label an example")
    examples = spark.read.parquet(a.examples)
    loop = Evolution(examples.cache(), task.n_classes, KeywordMiner(), Settings(iterations=a.iterations, per_round=a.per_round))
    history = [(h["iter"], h["accepted"], h["pool"], float(h["macro_f1"])) for h in loop.run()]
    _write(loop.votes, f"{a.out}/votes")
    _write(spark.createDataFrame(history, "iter int, accepted boolean, pool int, macro_f1 double"), f"{a.out}/history")
    _write(spark.createDataFrame(loop.killed, "iter int, lf string, reason string"), f"{a.out}/dropped")


def aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    from votelake.plans.aggregation import aggregate as decide

    task, votes = get_task(a.task), spark.read.parquet(a.votes)
    pool = sorted(r["lf"] for r in votes.select("lf").distinct().collect())  # the names of a pool
    _write(decide(spark.read.parquet(a.examples), votes, pool, task.n_classes, a.method, task.multi_label, a.cache, a.dim, a.folds), a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    from votelake.operators import metrics as mt

    task, examples, labels = get_task(a.task), spark.read.parquet(a.examples), spark.read.parquet(a.labels)
    if task.multi_label:
        _write(mt.multilabel_summary(examples, labels, task.n_classes), f"{a.out}/summary")
        return
    _write(mt.evaluate(examples, labels), f"{a.out}/splits")
    _write(mt.prf(mt.confusion(examples, labels)), f"{a.out}/classes")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    from votelake.operators import aggregate as ag
    from votelake.operators import downstream as ds

    task, examples, votes = get_task(a.task), spark.read.parquet(a.examples), spark.read.parquet(a.votes)
    if task.multi_label:
        raise ValueError("the grid needs one label an example")
    weak = ds.confident_rows(ag.majority(examples, votes).filter("split = 'train'"), votes)
    _write(ds.efficiency_grid(examples, weak, task.n_classes, tuple(a.sizes)), a.out)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    from votelake.plans import catalog

    if a.name not in catalog.QUERIES:
        raise KeyError(f"no query {a.name!r}; there are {', '.join(sorted(catalog.QUERIES))}")
    _write(catalog.QUERIES[a.name](spark, a.data), a.out)


COMMANDS = {f.__name__: f for f in (prepare, run, aggregate, evaluate, train, query)}


def main(args: list[str] | None = None) -> None:
    from votelake.session import build_session

    a = parser().parse_args(args)
    COMMANDS[a.command](build_session(a.master), a)


if __name__ == "__main__":
    main()
