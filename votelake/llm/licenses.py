"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Every block of up to ``LINES`` lines of every text is a possible header (blank
lines end a block) and every text a possible licence file; both are sparse
TF-IDF vectors compared with the templates by cosine.  Whole texts are also compared with whole licences and notice blocks
(``license_bodies``), there with logarithms of counts, as frequent words of
long texts would outweigh the rest.  Weights of template terms come from document counts over the whole
corpus; any other term has the weight of one never seen.  A file whose whole
text reaches ``FILE_COSINE`` licenses its directory; of several in one
directory the highest cosine counts, then the least path.  A file without a
licence of its own takes that of the nearest directory above it: directories
(not files) are joined to their ancestors, and files to their directory, hot
directories kept apart.

The templates and their vocabulary are fixed, so what executors are sent is
bounded: a count for each term of them.

Edge cases: null text is empty and has no licence; a null path is the root
directory's; a null doc_id is kept; ties take the earlier template and the
first line; repeated rows are scanned alike; other columns, whatever their
names, are not read; an empty table gives no rows; whole texts are read,
whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.llm.common import attach_per_key, materialize
from votelake.llm.license_bodies import bodies

LINE_COSINE = 0.6
FILE_COSINE = 0.6
#: Lines that a header may be spread over.
LINES = 3

TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
)

_TERM = re.compile(r"\w+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


VOCABULARY = frozenset(t for _, text in TEMPLATES for t in terms(text))
BODIES = tuple((name, Counter(terms(text))) for name, text in bodies())
COUNTED = VOCABULARY.union(*[tf for _, tf in BODIES])


def term_counts(files: DataFrame) -> DataFrame:
    """term and the number of files that contain it, for terms of templates and bodies; '' counts all files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[""] += 1
                if text:
                    seen.update(COUNTED.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return files.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Matcher:
    """Cosines of token lists with the templates."""

    def __init__(self, counts: dict[str, int]):
        files = counts.get("", 0)
        self.unseen = math.log(files + 1) + 1
        self.idf = {t: math.log((files + 1) / (counts.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.bodies = BodyMatcher(counts)
        self.by_term: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, text) in enumerate(TEMPLATES):
            tf = Counter(terms(text))
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in tf.items()))
            for t, n in tf.items():
                self.by_term[t].append((i, n * self.idf[t] / norm))

    def weigh(self, tokens: list[str]) -> tuple[Counter[str], list[str], float, float]:
        """Counts, the template terms among them, and the squared lengths of both parts of the vector."""
        tf = Counter(tokens)
        hits = sorted(VOCABULARY.intersection(tf))
        known = sum([(tf[t] * self.idf[t]) ** 2 for t in hits])
        squares = sum([n * n for n in tf.values()]) - sum([tf[t] ** 2 for t in hits])
        return tf, hits, known, squares * self.unseen**2

    def best(self, weighed: tuple[Counter[str], list[str], float, float], least: float) -> tuple[float, int]:
        """The highest cosine and its template's number; (0, -1) if it is under ``least``."""
        tf, hits, known, rest = weighed
        if not hits or known < least * least * (known + rest):  # no template can reach it
            return 0.0, -1
        score = [0.0] * len(TEMPLATES)
        for t in hits:
            w = tf[t] * self.idf[t]
            for i, v in self.by_term[t]:
                score[i] += w * v
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        cosine = min(1.0, score[top] / math.sqrt(known + rest))
        return (cosine, top) if cosine >= least else (0.0, -1)

    def scan(self, text: str) -> tuple[str | None, float, int, str | None, float]:
        """Header licence, its cosine and first line's number; licence of the whole file and its cosine."""
        found, score, at = -1, 0.0, -1
        everything: list[str] = []
        recent: list[tuple[int, list[str], tuple]] = []
        for i, line in enumerate(text.split("\n")):
            tokens = terms(line)
            if not tokens:
                recent = []
                continue
            everything += tokens
            recent = [*recent[1 - LINES :], (i, tokens, self.weigh(tokens))]
            block, length, rest = [], 0.0, 0.0
            for first, part, weighed in reversed(recent):
                block = part + block
                length, rest = length + math.sqrt(weighed[2]), rest + weighed[3]
                # a block's known part is at most as long as its lines' together, its rest at least
                if length * length * (1 - LINE_COSINE**2) < LINE_COSINE**2 * rest:
                    continue
                c, t = self.best(weighed if first == i else self.weigh(block), LINE_COSINE)
                if t >= 0 and c > score + 1e-12:
                    found, score, at = t, c, first
        c, t = self.best(self.weigh(everything), FILE_COSINE)
        name = lambda k: TEMPLATES[k][0] if k >= 0 else None
        file_license, b = name(t), self.bodies.best(everything, FILE_COSINE)
        if b[0] > c + 1e-12:
            c, file_license = b[0], BODIES[b[1]][0]
        return name(found), round(score, 9), at, file_license, round(c, 9)


class BodyMatcher:
    """Cosines of whole texts with the bodies, by logarithms of counts."""

    def __init__(self, counts: dict[str, int]):
        n = counts.get("", 0)
        self.unseen = math.log(n + 1) + 1
        self.place = {t: i for i, t in enumerate(sorted(COUNTED))}
        self.idf = np.array([math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in self.place])
        self.table = np.zeros((len(self.place), len(BODIES)))
        for k, (_, tf) in enumerate(BODIES):
            at = [self.place[t] for t in tf]
            self.table[at, k] = (1 + np.log(list(tf.values()))) * self.idf[at]
        self.table /= np.linalg.norm(self.table, axis=0)

    def best(self, tokens: list[str], least: float) -> tuple[float, int]:
        """The highest cosine and its body's number; (0, -1) if it is under ``least``."""
        tf = Counter(tokens)
        at, n = [], []
        for t in self.place.keys() & tf.keys():
            at.append(self.place[t])
            n.append(tf.pop(t))
        if not at:
            return 0.0, -1
        order = np.argsort(at)
        at, n = np.array(at)[order], np.array(n)[order]
        w = (1 + np.log(n)) * self.idf[at]
        known = float(w @ w)
        rest = float(((1 + np.log(np.fromiter(tf.values(), dtype=np.float64, count=len(tf)))) ** 2).sum()) * self.unseen**2
        if known < least * least * (known + rest):  # no body can reach it
            return 0.0, -1
        score = w @ self.table[at]
        top = int(score.argmax())
        cosine = min(1.0, float(score[top]) / math.sqrt(known + rest))
        return (cosine, top) if cosine >= least else (0.0, -1)


SCANNED = "doc_id bigint, path string, license string, score double, line int, file_license string, file_score double"


def scan(files: DataFrame) -> DataFrame:
    """Own licences of files(doc_id, path, text)."""
    counts = {r["term"]: r["n"] for r in term_counts(files).collect()}  # one row a template term

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(counts)
        for batch in batches:
            got = [m.scan(t or "") for t in batch.column(2).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64())
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "path", "license", "score", "line", "file_license", "file_score"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text").mapInArrow(run, SCANNED)


def directory(path: Column) -> Column:
    """All before the last slash; '' is the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, nearest first, down to the root ''."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds the nearest licensed directory's licence to files without their own."""
    placed = materialize(scanned.withColumn("folder", F.array_join(F.filter(F.split(directory(F.col("path")), "/"), lambda x: x != ""), "/")))
    rank = F.struct((-F.col("file_score")).alias("s"), F.coalesce("path", F.lit("")).alias("p"), F.col("file_license").alias("l"))
    licensed = placed.filter("file_license is not null").groupBy("folder").agg(F.min(rank).alias("b"))
    licensed = licensed.select(F.col("folder").alias("above"), F.col("b.l").alias("folder_license"), F.col("b.p").alias("license_file"))
    folders = placed.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    up = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("depth", "above"))
    nearest = up.join(licensed, "above").groupBy("folder").agg(F.min(F.struct("depth", "folder_license", "above", "license_file")).alias("b"))
    known = materialize(folders.join(nearest, "folder", "left").select("folder", "files", F.col("b.folder_license").alias("folder_license"), F.col("b.above").alias("license_folder"), F.col("b.license_file").alias("license_file")))
    met = attach_per_key(placed, known, "folder", "files", F.col("doc_id"))
    own = F.coalesce("file_license", "license")  # lines of a whole licence may name another, as the LGPL's do the GPL
    return met.select(
        "doc_id",
        "path",
        F.coalesce(own, "folder_license").alias("license"),
        F.when(own.isNotNull(), F.lit("own")).when(F.col("folder_license").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.greatest("score", "file_score").alias("score"),
        F.col("line").alias("header_line"),
        F.when(own.isNull(), F.col("license_folder")).alias("license_folder"),
        F.when(own.isNull(), F.col("license_file")).alias("license_file"),
    )


def scan_licenses(files: DataFrame) -> DataFrame:
    return inherit(scan(files))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``."""
    name = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("unknown"))
    return docs.select("doc_id", F.concat(name("source"), F.lit("/"), name("lang"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt")).alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
