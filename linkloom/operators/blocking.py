"""Buckets of equal keys, caps and budgets by their sizes, candidate pairs, ranking and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("family", "country", "payload")
SIDE = ("family", "other_source")
NO_RANK = 65_535


def bucket_counts(keys: DataFrame) -> DataFrame:
    """family, other_source, country, payload, c1, c2, pc of each key that both sides have; duplicate keys count."""
    sizes = keys.groupBy(*KEY, "source").agg(F.count(F.lit(1)).alias("n"))
    ours = sizes.filter("source = 1").select(*KEY, F.col("n").alias("c1"))
    theirs = sizes.filter("source > 1").select(*KEY, F.col("source").alias("other_source"), F.col("n").alias("c2"))
    return theirs.join(ours, list(KEY)).select("family", "other_source", "country", "payload", "c1", "c2", (F.col("c1") * F.col("c2")).alias("pc"))


def under_cap(buckets: DataFrame, cap: int, caps: dict[str, int] | None = None) -> DataFrame:
    """Buckets whose product is at most the cap, that of their family where there is one."""
    limit = F.lit(cap).cast("long")
    for family, own in (caps or {}).items():
        limit = F.when(F.col("family") == family, F.lit(own).cast("long")).otherwise(limit)
    return buckets.filter(F.col("pc") <= limit)


def budget_keep(buckets: DataFrame, budget: Column | int) -> DataFrame:
    """The smallest buckets of each family and side, until the pairs before one exceed the budget (one bucket overshoots).

    Buckets of one product are a class. Running totals are over classes, as many as the cap at most; only the class in
    which the budget ends is put in order, by country and payload.
    """
    budget = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    classes = buckets.groupBy(*SIDE, "pc").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*SIDE).orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("base", F.coalesce(F.sum(F.col("pc") * F.col("n")).over(before), F.lit(0))).withColumn("limit", budget)
    room = F.when(F.col("base") <= F.col("limit"), F.floor((F.col("limit") - F.col("base")) / F.col("pc")) + 1).otherwise(0)
    classes = classes.select(*SIDE, "pc", "n", room.cast("long").alias("room")).filter("room > 0")
    kept = buckets.join(F.broadcast(classes), [*SIDE, "pc"])  # at most cap rows per family and side
    whole, part = kept.filter("room >= n"), kept.filter("room < n")
    order = Window.partitionBy(*SIDE).orderBy("country", "payload")
    part = part.withColumn("at", F.row_number().over(order)).filter("at <= room").drop("at")
    return whole.union(part).select(*buckets.columns)


def candidate_pairs(kept: DataFrame, keys: DataFrame) -> DataFrame:
    """s1_id, other_id, other_source of all pairs that meet in a kept bucket, once each."""
    chosen = kept.select(*KEY, "other_source")
    ours = keys.filter("source = 1").select(*KEY, F.col("entity_id").alias("s1_id"))
    theirs = keys.filter("source > 1").select(*KEY, F.col("source").alias("other_source"), F.col("entity_id").alias("other_id"))
    return chosen.join(theirs, [*KEY, "other_source"]).join(ours, list(KEY)).select("s1_id", "other_id", "other_source").distinct()


def other_order() -> list[Column]:
    return [F.col("other_source").asc(), F.substring("other_id", 4, 20).cast("long").asc()]


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rnk from 0: by pri, then sec, falling, then by the counterpart's place."""
    order = Window.partitionBy("s1_id").orderBy(F.col("pri").desc(), F.col("sec").desc(), *other_order())
    return scored.withColumn("rnk", (F.row_number().over(order) - 1).cast("int"))


def entity_aggregates(topk: DataFrame) -> DataFrame:
    """s1_id, e_max, e_gap (to the second best, or to 0), e_mean5, e_n75 of its candidates."""
    at = lambda k: F.max(F.when(F.col("rnk") == k, F.col("pri")))
    return topk.groupBy("s1_id").agg(
        F.max("pri").alias("e_max"),
        (at(0) - F.coalesce(at(1), F.lit(0.0))).alias("e_gap"),
        F.avg(F.when(F.col("rnk") < 5, F.col("pri"))).alias("e_mean5"),
        F.count_if(F.col("pri") >= 0.75).alias("e_n75"),
    )


def decide(scored: DataFrame, score: str, threshold: float, gate: float | None) -> DataFrame:
    """Rows at the threshold, of entities whose best score reaches the gate."""
    best = Window.partitionBy("s1_id")
    chosen = scored.withColumn("best", F.max(score).over(best)).filter(F.col(score) >= threshold)
    return (chosen if gate is None else chosen.filter(F.col("best") >= gate)).drop("best")


def id_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1_id, ids: a row per entity of s1, its counterparts by source and number, joined by commas."""
    each = F.struct("other_source", F.substring("other_id", 4, 20).cast("long").alias("n"), "other_id")
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["other_id"]), ",").alias("ids"))
    return s1.join(lists, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


def trimmed_budgets(buckets: DataFrame, cap: int, full: int, trim: int) -> DataFrame:
    """family, other_source, budget: all pairs under the cap while they are at most full in total, else scaled down to trim."""
    sizes = under_cap(buckets, cap).groupBy(*SIDE).agg(F.sum("pc").alias("post_cap"))  # a row per family and side
    total = sizes.agg(F.sum("post_cap").alias("total"))
    scaled = F.greatest(F.lit(1).cast("long"), F.floor(F.col("post_cap") * (float(trim) / F.col("total"))).cast("long"))
    return sizes.crossJoin(F.broadcast(total)).select(*SIDE, F.when(F.col("total") <= full, F.col("post_cap")).otherwise(scaled).alias("budget"))


def family_report(buckets: DataFrame, kept: DataFrame, cap: int) -> DataFrame:
    """family, other_source (and an "all" row with 0), buckets, uncapped, post_cap, budget_kept, dropped_buckets."""
    chosen = kept.select(*KEY, "other_source", F.lit(1).alias("chosen"))
    marked = buckets.join(chosen, [*KEY, "other_source"], "left")
    sums = lambda df: df.agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.sum("pc").alias("uncapped"),
        F.coalesce(F.sum(F.when(F.col("pc") <= cap, F.col("pc"))), F.lit(0)).alias("post_cap"),
        F.coalesce(F.sum(F.when(F.col("chosen") == 1, F.col("pc"))), F.lit(0)).alias("budget_kept"),
        F.count_if(F.col("pc") > cap).alias("dropped_buckets"),
    )
    total = sums(marked.groupBy(F.lit("all").alias("family"), F.lit(0).alias("other_source")))
    return sums(marked.groupBy(*SIDE)).union(total)


def blocking_report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row: entities with and without candidates, pairs, their spread over entities and the reduction ratio."""
    per = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = records.agg(F.count_if(F.col("source") == 1).alias("n1"), F.count_if(F.col("source") > 1).alias("n23"))
    spread = per.agg(
        F.count(F.lit(1)).alias("entities_with_candidates"), F.sum("n").alias("n_pairs"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.max("n").alias("most"),
        F.round(F.percentile("n", 0.5), 6).alias("median_candidates"), F.round(F.percentile("n", 0.95), 6).alias("p95"),
    )
    both = spread.crossJoin(F.broadcast(sizes))
    return both.select(*spread.columns, (F.col("n1") - F.col("entities_with_candidates")).alias("entities_without"), F.round(F.col("n_pairs") / F.col("n1") / F.col("n23"), 9).alias("reduction_ratio"))
