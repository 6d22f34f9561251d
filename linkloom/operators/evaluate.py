"""Recall, F0.5, threshold search, ROC area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import NO_RANK

KS = (25, 50, 80, 150, 300, 500)
TAUS = tuple(round(0.30 + 0.025 * i, 3) for i in range(27))
GATES = tuple(round(0.45 + 0.05 * i, 2) for i in range(11))
GATE_SHARE = 0.98
_STEP = 0.0001


def traced(truth: DataFrame, pool: DataFrame) -> DataFrame:
    """truth with found and rnk in the pool (NO_RANK where it is not there)."""
    seen = pool.select("s1_id", "other_id", F.least("rnk", F.lit(NO_RANK - 1)).alias("at"))
    joined = truth.join(seen, ["s1_id", "other_id"], "left")
    return joined.select(*truth.columns, F.coalesce("at", F.lit(NO_RANK)).alias("rnk"), F.col("at").isNotNull().alias("found"))


def _share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def entity_share(pairs: DataFrame, hit: Column) -> DataFrame:
    """entities, complete, recall: entities all of whose true pairs are hit."""
    whole = pairs.groupBy("s1_id").agg(F.bool_and(hit).alias("whole"))
    return whole.agg(F.count(F.lit(1)).alias("entities"), F.count_if("whole").alias("complete"), _share(F.col("whole")).alias("recall"))


def segments(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with country of the S1 record and foreign, whether the counterpart's name is in another script."""
    ours = records.select(F.col("entity_id").alias("s1_id"), "country")
    theirs = records.select(F.col("entity_id").alias("other_id"), (F.col("name_script") != "latin").alias("foreign"), "name_script", "name_nonascii")
    return pairs.join(ours, "s1_id").join(theirs, "other_id")


def recall_at(pairs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, segment (all, country:..., non-latin, entities), n, recall; pairs come from segments(traced(...))."""
    spark = pairs.sparkSession
    grid = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    tags = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("country:"), "country"), F.when(F.col("foreign"), "non-latin")))
    by_tag = pairs.select(F.explode(tags).alias("segment"), "rnk").groupBy("segment", "rnk").agg(F.count(F.lit(1)).alias("n"))
    share = lambda df: df.crossJoin(grid).groupBy("k", "segment").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("rnk") < F.col("k"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recall"))
    worst = pairs.groupBy("s1_id").agg(F.max("rnk").alias("rnk")).groupBy(F.lit("entities").alias("segment"), "rnk").agg(F.count(F.lit(1)).alias("n"))
    return share(by_tag).union(share(worst))


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """Of one entity: 1 where there is neither truth nor prediction, 0 where there is only one or no hit."""
    p, r = tp / predicted, tp / true
    value = F.when((predicted == 0) | (true == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return F.when((predicted == 0) & (true == 0), 1.0).otherwise(value)


def macro_f05(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """entities, macro_f05, micro_precision, micro_recall; an empty denominator gives 1."""
    hits = predicted.select("s1_id", "other_id").join(truth.select("s1_id", "other_id", F.lit(1).alias("hit")), ["s1_id", "other_id"], "left")
    sums = hits.groupBy("s1_id").agg(F.count(F.lit(1)).alias("nh"), F.count("hit").alias("tp"))
    per = entities.join(sums, "s1_id", "left").fillna(0, ["nh", "tp"])
    ratio = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(1.0), 6)
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.round(F.avg(f05(F.col("tp"), F.col("nh"), F.col("n_true"))), 6).alias("macro_f05"),
        ratio("tp", "nh").alias("micro_precision"),
        ratio("tp", "n_true").alias("micro_recall"),
    )


def threshold_grid(entities: DataFrame, truth: DataFrame, scored: DataFrame, score: str, taus: tuple[float, ...] = TAUS, gates: tuple[float, ...] = GATES) -> DataFrame:
    """tau, gate (null: none), macro_f05, precision, recall of every decision.

    An entity's rows are counted by the highest tau they pass (one row per entity and tau at most), summed from the top, and
    an entity's gates are one number, the highest it passes; only entity totals meet the grid, and the grid's sums are
    kept by (tau, highest gate) before the gates are spread out.
    """
    taus, gates = sorted(taus), sorted(gates)
    step = lambda c, values: F.size(F.filter(F.array(*map(F.lit, values)), lambda t: t <= c))
    rows = scored.join(truth.select("s1_id", "other_id", F.lit(1).alias("hit")), ["s1_id", "other_id"], "left")
    rows = rows.select("s1_id", "hit", F.col(score).alias("score"))
    best = rows.groupBy("s1_id").agg(step(F.max("score"), gates).alias("g"))
    counts = rows.withColumn("t", step(F.col("score"), taus)).filter("t > 0").groupBy("s1_id", "t").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("tp"))
    steps = counts.groupBy("s1_id").agg(F.collect_list(F.struct("t", "n", "tp")).alias("steps"))  # at most a row per tau
    per = entities.join(best, "s1_id", "left").join(steps, "s1_id", "left").fillna(0, ["g"])
    above = lambda f: F.aggregate(F.filter(F.coalesce("steps", F.array().cast("array<struct<t:int,n:bigint,tp:bigint>>")), lambda s: s["t"] >= F.col("ti")), F.lit(0).cast("long"), lambda acc, s: acc + s[f])
    spread = per.select("n_true", "g", "steps", F.explode(F.sequence(F.lit(1), F.lit(len(taus)))).alias("ti"))
    spread = spread.select("n_true", "g", "ti", above("n").alias("nh"), above("tp").alias("tp"))
    none = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    held = spread.groupBy("ti", "g").agg(
        F.sum(f05(F.col("tp"), F.col("nh"), F.col("n_true"))).alias("f"), F.sum(none).alias("f0"), F.sum("nh").alias("nh"), F.sum("tp").alias("tp"), F.sum("n_true").alias("nt"), F.count(F.lit(1)).alias("e")
    )  # at most taus x (gates + 1) rows
    spark = scored.sparkSession
    tau_table = F.broadcast(spark.createDataFrame([(i + 1, t) for i, t in enumerate(taus)], "ti int, tau double"))
    gate_table = F.broadcast(spark.createDataFrame([(0, None), *((i + 1, g) for i, g in enumerate(gates))], "gi int, gate double"))
    passes = F.col("g") >= F.col("gi")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(1.0), 6)
    got = lambda c: F.sum(F.when(passes, F.col(c)).otherwise(0))
    return held.join(tau_table, "ti").crossJoin(gate_table).groupBy("tau", "gate").agg(
        F.round(F.sum(F.when(passes, F.col("f")).otherwise(F.col("f0"))) / F.sum("e"), 6).alias("macro_f05"),
        ratio(got("tp"), got("nh")).alias("precision"),
        ratio(got("tp"), F.sum("nt")).alias("recall"),
    )


def best_decision(grid: DataFrame) -> DataFrame:
    """The grid's best row: by F, then precision, then the smaller tau, then no gate or the smaller."""
    return grid.orderBy(F.col("macro_f05").desc(), F.col("precision").desc(), F.col("tau").asc(), F.col("gate").asc_nulls_first()).limit(1)


def roc_area(scored: DataFrame, score: str, label: str) -> DataFrame:
    """auc: the share of (true, false) pairs of rows in which the true one scores higher, ties by half; null without either.

    Rows are counted by score in steps of 1/10000 first, so the running total is over a bounded table.
    """
    cell = F.round(F.col(score) / _STEP).cast("long")
    cells = scored.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cells.withColumn("below", below).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / F.col("p") / F.col("n")), 6).alias("auc"))


def gate_check(pairs: DataFrame, records: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """metric, value, pass: pair and entity shares in the pool at any rank, and entity shares at each k; all but the second inform only."""
    pair = pairs.agg(F.lit("pairs in pool").alias("metric"), _share(F.col("found")).alias("value"), F.lit(None).cast("boolean").alias("pass"))
    entity = entity_share(pairs, F.col("found")).select(F.lit("entities in pool").alias("metric"), F.col("recall").alias("value"), (F.col("recall") >= GATE_SHARE).alias("pass"))
    at = recall_at(segments(pairs, records), ks).filter("segment = 'entities'")
    return pair.union(entity).union(at.select(F.concat(F.lit("entities at "), F.col("k").cast("string")), "recall", F.lit(None).cast("boolean")))
