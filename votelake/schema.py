"""Relations, tasks and the class dimension.

examples(id, split, gold, text, ...), votes(id, split, lf, vote) without
abstains, counts(id, split, class, n).  Gold is null where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ABSTAIN = -1

EXAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("true_label", T.StringType()),
        T.StructField("true_label_name", T.StringType()),
        T.StructField("true_labels", T.ArrayType(T.StringType())),
        T.StructField("label", T.StringType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

VOTES = "id bigint, split string, lf string, vote int"


@dataclass(frozen=True)
class Task:
    """A labelling task: class names by id, label mode, features annotators may use."""

    name: str
    classes: tuple[str, ...]
    multi_label: bool = False
    bool_features: tuple[str, ...] = ()
    guardrails: dict[int, str] = field(default_factory=dict)
    description: str = ""
    pairs: bool = False

    @property
    def family(self) -> str:
        """verification where a claim is checked against evidence, else classification."""
        return "verification" if self.pairs else "classification"

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    @property
    def label_key(self) -> str:
        return "true_labels" if self.multi_label else "true_label"

    def dimension(self, spark: SparkSession) -> DataFrame:
        """classes(task, class_id, name, guardrail), one row a class."""
        rows = [(self.name, i, n, self.guardrails.get(i)) for i, n in enumerate(self.classes)]
        return spark.createDataFrame(rows, "task string, class_id int, name string, guardrail string")


TASKS = {
    t.name: t
    for t in (
        Task("chemprot", ("Part of", "Regulator", "Upregulator", "Downregulator", "Agonist", "Antagonist", "Modulator", "Cofactor", "Substrate/Product", "NOT"), description="relation between a chemical and a protein"),
        Task("fever", ("Supports", "Refutes", "NotEnoughInfo"), bool_features=("has_url", "has_email", "negation_mismatch", "numbers_mismatch"), description="does evidence support a claim", pairs=True),
        Task("pubmed", tuple("ABCDEFGHIJLMNZ"), multi_label=True, description="top MeSH branches of an abstract"),
        Task("lang4", ("de", "en", "es", "fr"), bool_features=("has_url", "has_email", "has_digit", "has_pipe"), description="language of a document"),
        Task("quality", ("junk", "good"), bool_features=("has_url", "has_email", "has_digit", "has_pipe"), description="quality of a document, sparsely labelled"),
        Task("qt", ("quality", "toxic"), multi_label=True, bool_features=("has_url", "has_email", "has_digit", "has_pipe"), description="quality and toxicity flags of a document"),
    )
}


def get_task(name: str) -> Task:
    """The task of that name; the error lists those that exist."""
    if name not in TASKS:
        raise KeyError(f"unknown task {name!r}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]
