"""The linkage chain: records, keys, buckets, candidates, pool and what follows, each a DataFrame built on demand.

Tables that many steps read (records, keys, buckets, pool, scores) are kept in the shared folder under a name made of the
input's files and of the limits they depend on, so another query over the same input reads them instead of making them anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.lexicons import FAMILIES
from linkloom.operators import blocking, diagnose, evaluate, learning, linkage, profile
from linkloom.sources import cache
from linkloom.sources.directories import derived_truth, raw_records, read_ground_truth


@dataclass(frozen=True)
class Limits:
    """Production values: largest bucket product, pairs in all and per entity, decision, and full or trimmed volume."""

    cap: int = 5_000
    budget: int = 200_000_000
    top_k: int = 80
    tau: float = 0.5
    gate: float = 0.6
    full: int = 600_000_000
    trim: int = 500_000_000
    curve: tuple[int, ...] = (5_000, 20_000, 50_000)
    levels: tuple[int, ...] = diagnose.LEVELS
    plan_budget: int = diagnose.PLAN_BUDGET

    @property
    def side_budget(self) -> int:
        """The budget's equal share of each family and side."""
        return self.budget // (2 * len(FAMILIES))


class Chain:
    """Tables by name over one folder of input tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, limits: Limits = Limits()):  # noqa: B008
        self.spark, self.sf_dir, self.limits = spark, sf_dir, limits

    @classmethod
    def of_files(cls, spark: SparkSession, dataset: str, split: str, limits: Limits = Limits(), limit: int | None = None) -> Chain:  # noqa: B008
        """The chain over the files dataset/split/split_source1.tsv and so on; without a truth file there is no truth."""
        return _FileChain(spark, f"{dataset}/{split}/{split}", limits, limit)

    @cached_property
    def input(self) -> str:
        return cache.fingerprint(self.spark, f"{self.sf_dir}/documents.parquet")

    def _kept(self, label: str, parts: tuple, build) -> DataFrame:
        return cache.ensure(self.spark, label, (self.input, *parts), build)

    @cached_property
    def raw(self) -> DataFrame:
        return self._kept("raw", (), lambda: raw_records(self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")))

    @cached_property
    def records(self) -> DataFrame:
        return self._kept("records", (), lambda: linkage.normalise(self.raw))

    @cached_property
    def truth(self) -> DataFrame:
        return self._kept("truth", (), lambda: derived_truth(self.raw))

    @cached_property
    def entities(self) -> DataFrame:
        """s1_id, country, n_true of every S1 row."""
        counts = self.truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
        return self.raw.filter("source = 1").select(F.col("entity_id").alias("s1_id"), "country").join(counts, "s1_id", "left").fillna(0, ["n_true"])

    @cached_property
    def keys(self) -> DataFrame:
        return self._kept("keys", (), lambda: linkage.blocking_keys(self.records))

    @cached_property
    def buckets(self) -> DataFrame:
        return self._kept("buckets", (), lambda: blocking.bucket_counts(self.keys))

    @cached_property
    def kept(self) -> DataFrame:
        return blocking.budget_keep(blocking.under_cap(self.buckets, self.limits.cap), self.limits.side_budget)

    @cached_property
    def pairs(self) -> DataFrame:
        return blocking.candidate_pairs(self.kept, self.keys)

    @cached_property
    def pool(self) -> DataFrame:
        """s1_id, other_id, other_source, pri, sec, rnk of every candidate pair."""
        limits = (self.limits.cap, self.limits.budget)
        return self._kept("pool", limits, lambda: blocking.ranked(linkage.cheap_scores(self.pairs, self.records)))

    @cached_property
    def topk(self) -> DataFrame:
        return self.pool.filter(F.col("rnk") < self.limits.top_k)

    @cached_property
    def aggregates(self) -> DataFrame:
        return blocking.entity_aggregates(self.topk)

    @cached_property
    def decided(self) -> DataFrame:
        return blocking.decide(self.topk, "pri", self.limits.tau, self.limits.gate)

    @cached_property
    def traced(self) -> DataFrame:
        return evaluate.traced(self.truth, self.pool)

    @cached_property
    def categories(self) -> DataFrame:
        return diagnose.miss_categories(self.traced, self.records, self.limits.top_k)

    @cached_property
    def trace(self) -> DataFrame:
        return diagnose.traces(self.traced, self.keys, self.buckets, self.limits.cap)

    @cached_property
    def split(self) -> DataFrame:
        return learning.learn_split(learning.stratified_split(self.entities))

    @cached_property
    def features(self) -> DataFrame:
        """Features of the kept candidates and of all true pairs."""
        limits = (self.limits.cap, self.limits.budget, self.limits.top_k)
        pairs = self.topk.select("s1_id", "other_id").union(self.truth.select("s1_id", "other_id")).distinct()
        return self._kept("features", limits, lambda: learning.feature_matrix(pairs, self.records, self.aggregates))

    @cached_property
    def model(self):
        return learning.train(learning.training_rows(self.split, self.topk, self.truth), self.features)

    @cached_property
    def scores(self) -> DataFrame:
        """s1_id, other_id, other_source, score of every kept candidate, by the model."""
        limits = (self.limits.cap, self.limits.budget, self.limits.top_k)
        kept = self.topk.select("s1_id", "other_id", "other_source")
        return self._kept("scores", limits, lambda: kept.join(learning.score(self.model, self.features), ["s1_id", "other_id"]))

    @cached_property
    def val_grid(self) -> DataFrame:
        """The threshold grid of the model's scores on the val entities."""
        val = self.split.filter("part = 'val'").select("s1_id")
        return evaluate.threshold_grid(self.entities.join(val, "s1_id", "left_semi"), self.truth, self.scores.join(val, "s1_id", "left_semi"), "score")

    @cached_property
    def predicted(self) -> DataFrame:
        """The pairs that the tuned decision takes."""
        best = evaluate.best_decision(self.val_grid).first()
        return blocking.decide(self.scores, "score", best["tau"], best["gate"])


class _FileChain(Chain):
    """A chain whose records and truth come from files that begin with sf_dir."""

    def __init__(self, spark: SparkSession, stem: str, limits: Limits, limit: int | None):
        super().__init__(spark, stem, limits)
        self.limit = limit

    @cached_property
    def input(self) -> str:
        return cache.fingerprint(self.spark, f"{self.sf_dir}_*.tsv") + str(self.limit)

    @cached_property
    def raw(self) -> DataFrame:
        rows = profile.read_all(self.spark, {s: f"{self.sf_dir}_source{s}.tsv" for s in (1, 2, 3)}, self.limit)
        return self._kept("raw", (), lambda: rows.withColumn("country", F.trim("country")))

    @cached_property
    def truth(self) -> DataFrame:
        path = f"{self.sf_dir}_ground_truth.tsv"
        if not cache.exists(self.spark, path):
            return self.spark.createDataFrame([], "s1_id string, other_id string")
        return self._kept("truth", (), lambda: read_ground_truth(self.spark, path).select("s1_id", F.explode("others").alias("other_id")).distinct())
