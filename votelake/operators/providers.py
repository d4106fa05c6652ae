"""Interfaces to models that are not shipped, with deterministic stand-ins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.analyze import counted_keywords, word_counts
from votelake.operators.annotators import Annotator, keyword_rule


class CandidateProvider(Protocol):
    """Proposes annotators for target classes; a language model would sit behind this."""

    def propose(self, examples: DataFrame, targets: list[int], n: int, tag: str) -> list[Annotator]: ...


class KeywordMiner:
    """Stand-in for a language model: rules of a class's distinctive words, a bank of words each.

    Learns from rows with gold (split train) and proposes at most ``n`` rules
    for each target, or for every class where no target is given; a later call
    moves on to later words of the ranking.
    """

    def __init__(self, bank: int = 4):
        self.bank, self.used = bank, 0
        self.read, self.counts = None, None

    def propose(self, examples: DataFrame, targets: list[int], n: int, tag: str) -> list[Annotator]:
        if self.read is not examples:
            rows = examples.filter("split = 'train' and gold is not null").select(F.col("gold").alias("group"), tx.tokens(F.col("text")).alias("tokens"))
            # classes x words, counted once for all calls
            self.read, self.counts = examples, word_counts(rows).cache()
        ranked = counted_keywords(self.counts, k=self.bank * (n + self.used))
        top = (ranked.filter(F.col("group").isin(*targets)) if targets else ranked).collect()  # classes x words, bounded by the parameters
        out = []
        for c in sorted({r["group"] for r in top}):
            words = [r["word"] for r in sorted(top, key=lambda r: r["rank"]) if r["group"] == c]
            for i in range(self.used, self.used + n):
                bank = words[i * self.bank : (i + 1) * self.bank]
                if bank:
                    out.append(keyword_rule(f"lf_{tag}_c{c}b{i}", c, bank))
        self.used += n
        return out


class Responses:
    """Cached completions: payloads whose key is unknown are asked once, the rest are joined.

    ``ask`` gets a list of payloads of one batch; without it a miss is an error.
    """

    def __init__(self, cache: DataFrame, ask=None, batch: int = 1000):  # noqa: ANN001
        self.cache, self.ask, self.batch = cache, ask, batch

    def misses(self, requests: DataFrame) -> DataFrame:
        keyed = requests.withColumn("cache_key", tx.cache_key(F.col("payload")))
        return keyed.join(self.cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])

    def resolve(self, requests: DataFrame) -> DataFrame:
        missing = self.misses(requests)
        rows = missing.limit(self.batch + 1).collect()
        if len(rows) > self.batch:
            raise ValueError(f"over {self.batch} uncached requests; split the batch")
        if rows and self.ask is None:
            raise LookupError("no completion provider is set and the cache has no answer")
        if rows:
            fresh = [(r["cache_key"], x) for r, x in zip(rows, self.ask([r["payload"] for r in rows]), strict=True)]
            self.cache = self.cache.unionByName(requests.sparkSession.createDataFrame(fresh, "cache_key string, response string"))
        return requests.withColumn("cache_key", tx.cache_key(F.col("payload"))).join(self.cache, "cache_key", "left")


def backoff_seconds(attempt: int, retry_after: float | None = None, cap: float = 90.0) -> float:
    """Wait before a retry: what the server asks, else doubling to 60 s; never over the cap."""
    return min(cap, retry_after if retry_after is not None else min(60.0, 2.0**attempt))


def hashed_embedding(df: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """emb: signed hashes of token sets, L2-normalised; a stand-in for a sentence encoder."""
    tokens = df.withColumn("__t", tx.tokens(F.col(text)))
    at = lambda i: F.aggregate("__t", F.lit(0.0), lambda a, t: a + F.when(F.pmod(F.xxhash64(t), F.lit(dim)) == i, F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    raw = tokens.withColumn("emb", F.array(*[at(i) for i in range(dim)])).drop("__t")
    norm = F.sqrt(tx.dot(F.col("emb"), F.col("emb")))
    return raw.withColumn("emb", F.when(norm > 0, F.transform("emb", lambda x: x / norm)).otherwise(F.col("emb")))


def entailment(*_, **__):  # noqa: ANN002, ANN003, ANN201
    raise NotImplementedError("entailment probabilities need a model; pass your own provider of (p_support, p_refute, p_neutral)")
