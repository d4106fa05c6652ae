"""Scans: JSONL in strict and lenient mode, records by id, zipped CSV, embeddings, configs, run folders."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelake.functions.text import strip
from votelake.schema import EXAMPLE


def label_array(labels: Column) -> Column:
    """Cast to int, drop what is none, distinct, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def normalize_labels(rows: DataFrame) -> DataFrame:
    """Gives every row true_label and true_labels, whichever it came with.

    A list wins; its lowest (or -1) is the single label where that is missing.
    A single label of at least 0 makes a list of one; others make none.
    """
    names = rows.columns
    single = F.col("true_label").cast("string").try_cast("int") if "true_label" in names else F.lit(None).cast("int")
    many = F.col("true_labels") if "true_labels" in names else F.lit(None).cast("array<string>")
    listed = label_array(many.cast("array<string>"))
    empty = F.array().cast("array<int>")
    had = F.col("true_label").isNotNull() if "true_label" in names else F.lit(False)
    sets = F.when(many.isNotNull(), listed).when(single >= 0, F.array(single)).otherwise(empty)
    one = F.when(had, F.coalesce(single, F.lit(-1))).when(many.isNotNull(), F.coalesce(F.get(listed, F.lit(0)), F.lit(-1))).otherwise(-1)
    return rows.withColumn("__sets", sets).withColumn("true_label", one).withColumn("true_labels", F.col("__sets")).drop("__sets")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = EXAMPLE, mode: str = "strict") -> DataFrame:
    """JSON lines with a declared schema; strict fails on a malformed line, lenient drops it.

    In lenient mode a missing path is an empty table.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED")
    if mode != "strict" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader.json(path)


def read_examples(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    return normalize_labels(read_jsonl(spark, path, EXAMPLE, mode))


def read_multilabel(spark: SparkSession, path: str, n_classes: int) -> DataFrame:
    """Label sets and their binary rows; a row with neither kind of label is an error."""
    raw = read_jsonl(spark, path)
    checked = raw.withColumn("__ok", F.when(F.col("true_labels").isNull() & F.col("true_label").isNull(), F.raise_error(F.lit("row without true_label and true_labels"))).otherwise(True)).filter("__ok").drop("__ok")
    rows = normalize_labels(checked)
    return rows.withColumn("y", multi_hot(F.col("true_labels"), n_classes))


def multi_hot(labels: Column, n_classes: int) -> Column:
    """0/1 by class; ids out of range are ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.array_contains(labels, c).cast("tinyint"))


def load_splits(spark: SparkSession, folder: str) -> DataFrame:
    """All splits of a task as one table with a split column (``train.jsonl`` and so on, or a partitioned table)."""
    parts = []
    for split in ("train", "val", "test"):
        if exists(spark, f"{folder}/{split}.jsonl"):
            parts.append(read_examples(spark, f"{folder}/{split}.jsonl").withColumn("split", F.lit(split)))
    if not parts:
        return spark.read.parquet(folder)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_records(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON object of objects by id (a file each) as rows of id and the value's fields."""
    doc = spark.read.text(path, wholetext=True)
    entries = doc.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("id", "v"))
    return entries.select("id", "v.*")


def flatten_evidence(evidence: Column) -> Column:
    """Third elements of triples, and pieces that are bare strings (arrays of one element), joined by a blank, trimmed.

    A piece of two elements holds no text and is left out.
    """
    return strip(F.array_join(F.filter(F.transform(evidence, lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))).otherwise(F.get(e, F.lit(2)))), lambda x: x.isNotNull()), " "))


def evidence_pieces(value: Column) -> Column:
    """JSON evidence, whose pieces are strings or arrays, as arrays of strings; a bare string is an array of one."""
    pieces = F.from_json(value, "array<string>")
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\s*\["), F.from_json(p, "array<string>")).otherwise(F.array(p)))


def claim_text(claim: Column, evidence: Column, placeholder: str = "(none found)") -> Column:
    ev = F.when(F.coalesce(evidence, F.lit("")) == "", placeholder).otherwise(evidence)
    return F.concat(F.lit("Claim: "), claim, F.lit("\nEvidence: "), ev)


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """The largest CSV of a zip file, folders of resource forks left out; one archive is one file and is opened on the driver."""
    blob = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
        csvs = [i for i in z.infolist() if i.filename.lower().endswith(".csv") and "__MACOSX" not in i.filename]
        if not csvs:
            raise FileNotFoundError(f"no CSV in {path}")
        name = max(csvs, key=lambda i: i.file_size).filename
        lines = io.StringIO(z.read(name).decode("utf-8"), newline="").readlines()
    if not lines:
        return spark.createDataFrame([], "value string")
    table = csv.reader(lines)
    header = next(table)
    records = [tuple(r) for r in table if len(r) == len(header)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.createDataFrame(records, schema)


def binary_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Columns whose non-null values are all 0/1 or booleans: one pass over all columns."""
    names = [c for c in df.columns if c not in skip]
    tests = [F.bool_and(F.col(c).isNull() | F.lower(F.col(c).cast("string")).isin("0", "1", "true", "false", "0.0", "1.0")).alias(c) for c in names]
    got = df.agg(*tests).first()
    return [c for c in names if got[c]]


def text_column(df: DataFrame, wanted: tuple[str, ...] = ("text", "abstractText", "abstract", "body")) -> Column:
    """The first of the wanted columns, else title and the rest of the strings joined."""
    for c in wanted:
        if c in df.columns:
            return F.col(c)
    return F.concat_ws(" ", *[F.col(c) for c, t in df.dtypes if t == "string"])


def columns_to_labels(columns: list[str]) -> Column:
    """Sorted class ids of the 0/1 columns that are set."""
    flags = F.array(*[F.when(F.lower(F.col(c).cast("string")).isin("1", "true", "1.0"), F.lit(i)) for i, c in enumerate(columns)])
    return F.filter(flags, lambda x: x.isNotNull())


def read_embeddings(spark: SparkSession, path: str, id_column: str = "id", emb_column: str = "emb") -> DataFrame:
    """emb by id as string."""
    return spark.read.parquet(path).select(F.col(id_column).cast("string").alias("id"), F.col(emb_column).alias("emb"))


# -------------------------------------------------------- configs and folders


def load_config(path: str) -> dict:
    """YAML with ``${a.b}`` references resolved until nothing changes; what is unknown stays as it is."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    for _ in range(20):
        resolved = _resolve(config, config)
        if resolved == config:
            return config
        config = resolved
    return config


def lookup(config: dict, dotted: str, default=None):  # noqa: ANN001, ANN201
    at = config
    for key in dotted.split("."):
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def _resolve(value, config: dict):  # noqa: ANN001, ANN202
    if isinstance(value, dict):
        return {k: _resolve(v, config) for k, v in value.items()}
    if isinstance(value, list):
        return [_resolve(v, config) for v in value]
    if isinstance(value, str):
        whole = re.fullmatch(r"\$\{([\w.]+)\}", value)
        if whole:
            found = lookup(config, whole[1])
            return value if found is None else found
        return re.sub(r"\$\{([\w.]+)\}", lambda m: m[0] if (x := lookup(config, m[1])) is None else str(x), value)
    return value


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so that any store that Spark reads is asked."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def newest_iteration(spark: SparkSession, root: str) -> str | None:
    """The ``iter_N`` folder of the highest number under the root, or under its ``pipeline`` folder."""
    for top in (root, f"{root}/pipeline"):
        if not exists(spark, top):
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(top)
        names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
        found = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"iter_(\d+)", n))]
        if found:
            return f"{top}/{max(found)[1]}"
    return None


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document (report, brief, memory) as one row."""
    return spark.read.option("multiLine", True).json(path)


DATASETS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def dataset(name: str) -> Callable:
    """Registers a preparation function under a task's name."""

    def register(f: Callable) -> Callable:
        DATASETS[name] = f
        return f

    return register


def prepare(spark: SparkSession, config: dict) -> DataFrame:
    """Runs the preparation that the config's ``task`` names."""
    name = config.get("task")
    if name not in DATASETS:
        raise KeyError(f"no preparation for {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, config)


@dataset("chemprot")
def prepare_relations(spark: SparkSession, config: dict) -> DataFrame:
    """Relation records ``{id: {label, data: {text, entity1, entity2, span1, span2}}}`` by split."""
    from votelake.functions import text as tx

    parts = []
    for split in ("train", "val", "test"):
        r = read_records(spark, f"{config['raw']}/{split}.json", "label int, data struct<text:string,entity1:string,entity2:string,span1:array<int>,span2:array<int>>")
        parts.append(r.withColumn("split", F.lit(split)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    text = F.col("data.text")
    meta = F.struct("data.entity1", "data.entity2", "data.span1", "data.span2", tx.normalize(text).alias("text_normalized"), F.length(text).alias("num_chars"), tx.num_words(text).alias("num_words"))
    return rows.select("id", "split", text.alias("text"), F.col("label").alias("true_label"), F.array("label").alias("true_labels"), meta.alias("metadata"))


@dataset("fever")
def prepare_claims(spark: SparkSession, config: dict) -> DataFrame:
    """Claims with nested evidence lists, as text of both with simple features."""
    from votelake.functions import text as tx

    rows = spark.read.schema("id string, split string, claim string, label int, evidence string").json(config["raw"])
    ev = flatten_evidence(evidence_pieces(F.col("evidence")))
    out = rows.withColumn("ev", ev).withColumn("text", claim_text(F.col("claim"), F.col("ev")))
    meta = F.struct("claim", F.col("ev").alias("evidence"), tx.normalize(F.col("text")).alias("text_normalized"), F.length("text").alias("num_chars"), tx.num_words(F.col("text")).alias("num_words"), tx.has_url(F.col("text")).alias("has_url"), tx.has_email(F.col("text")).alias("has_email"))
    return out.select("id", "split", "text", F.col("label").alias("true_label"), F.array("label").alias("true_labels"), meta.alias("metadata"))


@dataset("pubmed")
def prepare_topics(spark: SparkSession, config: dict) -> DataFrame:
    """A CSV with a 0/1 column a topic: detects those columns, makes label sets, splits 80/10/10 by exact rank."""
    from votelake.operators.sampling import exact_split

    raw = read_zipped_csv(spark, config["raw"]) if config["raw"].endswith(".zip") else spark.read.option("header", True).option("inferSchema", True).csv(config["raw"])
    flags = binary_columns(raw, tuple(config.get("skip", ("id", "pmid"))))
    rows = raw.select(F.xxhash64(text_column(raw)).alias("id"), text_column(raw).alias("text"), columns_to_labels(flags).alias("true_labels"))
    return exact_split(rows, val_cap=config.get("val_budget"), seed=config.get("seed", 42))
