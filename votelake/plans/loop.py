"""The pool evolution loop and its default pipeline over a candidate provider."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.operators import aggregate as ag
from votelake.operators import analyze as az
from votelake.operators import evolve as ev
from votelake.operators import metrics as mt
from votelake.operators.annotators import Annotator, run_pool
from votelake.operators.providers import CandidateProvider


@dataclass
class Settings:
    """Parameters of a run; ``gate_split`` decides which split the do-no-harm gate reads."""

    iterations: int = 3
    per_round: int = 6
    min_precision: float = 0.25
    min_fires: int = 5
    gap: float = 0.30
    jaccard: float = 0.95
    subsumption_gain: float = 0.05
    f1_threshold: float = 0.40
    max_targets: int = 3
    refine_from: int = 3
    ablation: float = 0.001
    drop: float = 0.020
    min_gain: float = 0.0
    gate_split: str = "val"
    dropout_after: int = 99


@dataclass
class Evolution:
    """Pool, votes (each annotator is run once) and the history of a run."""

    examples: DataFrame
    n_classes: int
    provider: CandidateProvider
    settings: Settings = field(default_factory=Settings)
    pool: dict[str, Annotator] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    killed: list[tuple[int, str, str]] = field(default_factory=list)
    votes: DataFrame | None = None

    def __post_init__(self) -> None:
        # what the analyses join to votes: three small columns, not the texts
        self.rows = self.examples.select("id", "split", "gold").cache()
        self.scores: dict[str, list] = {}

    def _run(self, candidates: list[Annotator]) -> DataFrame:
        return run_pool(self.examples, candidates, once=True)

    def _metrics(self, names: list[str]) -> DataFrame:
        """Metrics of annotators that were run; they never change, so they are counted once, when an annotator is."""
        return self.examples.sparkSession.createDataFrame([r for n in names for r in self.scores[n]], self.schema)

    def _measure(self, votes: DataFrame, names: list[str]) -> DataFrame:
        pool = self.examples.sparkSession.createDataFrame([(n,) for n in names], "lf string")
        m = mt.annotator_metrics(self.rows, votes, pool)
        self.schema = m.schema
        self.scores |= {n: [] for n in names}
        for r in m.collect():  # pool x splits
            self.scores[r["lf"]].append(r)
        return self._metrics(names)

    def admit(self, candidates: list[Annotator], step: int, consistency: bool = True) -> list[str]:
        """Gates in order of cost: threshold on val, train/val gap, Jaccard against the pool."""
        fresh = [c for c in candidates if c.name not in self.pool]
        if not fresh:
            return []
        s = self.settings
        votes = self._run(fresh)
        m = self._measure(votes, [c.name for c in fresh])
        passed = ev.threshold_gate(m.filter("split = 'val'"), s.min_precision, s.min_fires).select("lf")
        steady = ev.consistency_gate(m, s.gap).select("lf") if consistency else passed
        kept = [r["lf"] for r in passed.join(steady, "lf", "left_semi").collect()]  # the pool at most
        alive = votes.filter(F.col("lf").isin(kept)) if kept else votes.limit(0)
        existing = self.votes if self.votes is not None else votes.limit(0)
        names = ev.greedy_jaccard(existing.filter("split = 'val'"), alive.filter("split = 'val'"), s.jaccard)
        final = m.sparkSession.createDataFrame([(n,) for n in names], "lf string")
        log = ev.kill_log(m.filter("split = 'val'"), final, [("threshold", passed), ("gap", steady), ("jaccard", final)])
        self.killed += [(step, r["lf"], r["reason"]) for r in log.select("lf", "reason").collect()]
        by_name = {c.name: c for c in fresh}
        self.pool |= {n: by_name[n] for n in names}
        added = votes.filter(F.col("lf").isin(names)) if names else votes.limit(0)
        self.votes = added if self.votes is None else self.votes.unionByName(added)
        return names

    def drop(self, names: list[str]) -> None:
        if names:
            self.pool = {k: v for k, v in self.pool.items() if k not in names}
            self.votes = self.votes.filter(~F.col("lf").isin(names))

    def evaluate(self) -> dict:
        held, votes = (x.filter(F.col("split") == self.settings.gate_split) for x in (self.rows, self.votes))
        labels = ag.majority(held, votes).cache()
        c = mt.prf(mt.confusion(held, labels))
        rows = {r["class"]: r["f1"] for r in c.select("class", "f1").collect()}  # one row a class
        total = mt.evaluate(held, labels).first()
        labels.unpersist()
        f1 = [rows.get(k) or 0.0 for k in range(self.n_classes)]
        return {"macro_f1": sum(f1) / self.n_classes, "f1": f1, "coverage": total["coverage"] if total else 0.0, "accuracy": total["accuracy_on_covered"] if total else None, "pool": len(self.pool)}

    def run(self) -> list[dict]:
        """iter 0 seeds the pool; later ones target weak classes, refine, prune, ablate and pass the gate or are reverted."""
        s = self.settings
        self.admit(self.provider.propose(self.examples, [], s.per_round, "g00"), 0, consistency=False)
        if self.votes is None or not self.pool:
            raise ValueError("no candidate passed the first gate")
        self.history = [{"iter": 0, "accepted": True, **self.evaluate()}]
        streak = {c: 0 for c in range(self.n_classes)}
        for k in range(1, s.iterations + 1):
            before = self.history[-1]
            saved = dict(self.pool), self.votes
            blocked = [c for c, n in streak.items() if n >= s.dropout_after]
            weak = sorted((f, c) for c, f in enumerate(before["f1"]) if f < s.f1_threshold and c not in blocked)[: s.max_targets]
            new = self.admit(self.provider.propose(self.examples, [c for _, c in weak], s.per_round, f"i{k:02d}"), k)
            if k >= s.refine_from:
                targets = ev.refine_targets(self._metrics(list(self.pool)).filter("split = 'train'")).collect()
                classes = sorted({self.pool[t["lf"]].target for t in targets if self.pool[t["lf"]].target is not None})
                if classes:
                    new += self.admit(self.provider.propose(self.examples, classes, 2, f"r{k:02d}"), k, consistency=False)
            if new:
                val = self.votes.filter("split = 'val'")
                p = self._metrics(list(self.pool)).filter("split = 'val'").select("lf", F.coalesce("precision", F.lit(0.0)).alias("precision"))
                names = self.examples.sparkSession.createDataFrame([(n,) for n in new], "lf string")
                self.drop([r["lf"] for r in ev.subsumed(val, p, names, gain=s.subsumption_gain).collect()])
                self.drop(ev.ablate(self.rows.filter("split = 'val'"), self.votes.filter("split = 'val'"), new, self.n_classes, s.ablation))
            after = self.evaluate()
            ok = ev.accept(before["macro_f1"], after["macro_f1"], s.drop, s.min_gain)
            if not ok:
                self.pool, self.votes = saved
                after = self.evaluate()
            for c in streak:
                hit = any(self.pool[n].target == c for n in new if n in self.pool)
                streak[c] = 0 if hit else streak[c] + 1
            self.history.append({"iter": k, "accepted": ok, **after})
        return self.history

    def brief(self) -> dict[str, DataFrame]:
        """The analyses that steer the next round, as small tables."""
        stats = az.vote_stats(self.examples, self.votes)
        targets = az.improvement_targets(self.examples, stats)
        return {"pool_summary": az.pool_summary(stats), "class_recall": az.class_recall(stats), "fragility": az.fragility(stats), "overlap": az.overlap(self.votes, 0.3), "targets": targets, "recommendations": az.recommendations(stats, targets, pairs=az.overlap(self.votes))}
