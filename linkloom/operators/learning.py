"""Splits, hard negatives, the feature matrix, training, scoring and the tuned decision of the pair classifier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources import cache

from . import linkage

SEED, VAL_FRAC, STOP_FRAC, NEG_CAP = 42, 0.10, 0.15, 6
#: Boosted trees at most (with early stopping), and below TINY rows, where all are grown.
TREES, TINY_TREES, TINY = 200, 60, 2_000
SCORES = ("e_max", "e_gap", "e_mean5", "e_n75")


def _hash(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def first_by_hash(df: DataFrame, group: str, key: str, take: Callable[[Column], Column], seed: int) -> DataFrame:
    """df with chosen: whether a row is among the first take(n) of the n rows of its group, by a hash of its key.

    Hashes are counted by their first four digits; only the cell in which a group's share ends is put in order.
    """
    df = df.withColumn("h", _hash(seed, key)).withColumn("cell", F.substring("h", 1, 4))
    cells = df.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    sizes = cells.groupBy(group).agg(F.sum("m").alias("n"))
    cells = cells.join(sizes, group).select(group, "cell", "m", (take(F.col("n")) - F.col("base")).alias("room"))
    placed = df.join(cells, [group, "cell"])
    sure = placed.filter("room <= 0 OR room >= m").withColumn("chosen", F.col("room") > 0)
    edge = placed.filter("room > 0 AND room < m")
    edge = edge.withColumn("chosen", F.row_number().over(Window.partitionBy(group).orderBy("h", key)) <= F.col("room"))
    return sure.union(edge).select(*[c for c in df.columns if c not in ("h", "cell")], "chosen")


def stratified_split(entities: DataFrame, frac: float = VAL_FRAC, seed: int = SEED) -> DataFrame:
    """s1_id, stratum, part: a share of each country x match-count stratum, at least one entity, goes to val."""
    n = F.col("n_true")
    size = F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")
    df = entities.select("s1_id", F.concat_ws("|", "country", size).alias("stratum"))
    share = first_by_hash(df, "stratum", "s1_id", lambda n: F.greatest(F.lit(1), F.bround(n * frac)).cast("long"), seed)
    return share.select("s1_id", "stratum", F.when(F.col("chosen"), "val").otherwise("fit").alias("part"))


def learn_split(split: DataFrame, frac: float = STOP_FRAC, seed: int = SEED + 1) -> DataFrame:
    """s1_id, part: the fit entities cut into stop and learn, the others as they are."""
    fit = first_by_hash(split.filter("part = 'fit'").select("s1_id", "part"), "part", "s1_id", lambda n: F.bround(n * frac).cast("long"), seed)
    return fit.select("s1_id", F.when(F.col("chosen"), "stop").otherwise("learn").alias("part")).union(split.filter("part <> 'fit'").select("s1_id", "part"))


def hard_negatives(candidates: DataFrame, truth: DataFrame, cap: int = NEG_CAP, seed: int = SEED) -> DataFrame:
    """At most cap false candidates of each entity, in the order of a hash."""
    wrong = candidates.select("s1_id", "other_id").join(truth.select("s1_id", "other_id"), ["s1_id", "other_id"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy(_hash(seed, "s1_id", "other_id"), "other_id")
    return wrong.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= cap).select("s1_id", "other_id")


def with_aggregates(pairs: DataFrame, aggregates: DataFrame) -> DataFrame:
    """pairs with the aggregates of their entity's candidates, 0 where it has none."""
    return pairs.join(aggregates, "s1_id", "left").fillna(0, list(SCORES))


def feature_matrix(pairs: DataFrame, records: DataFrame, aggregates: DataFrame) -> DataFrame:
    """All 40 features of pairs(s1_id, other_id)."""
    return with_aggregates(linkage.all_features(pairs, records), aggregates)


def training_rows(split: DataFrame, candidates: DataFrame, truth: DataFrame, neg_cap: int = NEG_CAP, seed: int = SEED) -> DataFrame:
    """s1_id, other_id, label, part. learn: all true pairs, found by blocking or not, and hard negatives; stop and val: all candidates."""
    true = truth.select("s1_id", "other_id").distinct()
    learn = split.filter("part = 'learn'").select("s1_id")
    held = candidates.select("s1_id", "other_id").join(split.filter("part <> 'learn'"), "s1_id").join(true.withColumn("label", F.lit(1.0)), ["s1_id", "other_id"], "left").fillna(0.0, ["label"])
    yes = true.join(learn, "s1_id", "left_semi").select("s1_id", "other_id", F.lit(1.0).alias("label"), F.lit("learn").alias("part"))
    no = hard_negatives(candidates.join(learn, "s1_id", "left_semi"), truth, neg_cap, seed).select("s1_id", "other_id", F.lit(0.0).alias("label"), F.lit("learn").alias("part"))
    return yes.union(no).union(held.select("s1_id", "other_id", "label", "part"))


def train(rows: DataFrame, features: DataFrame, trees: int = TREES, seed: int = SEED):
    """A boosted-trees model on the learn rows, stopped early on the stop rows; None without rows of both labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [c for c in features.columns if c not in ("s1_id", "other_id")]
    joined = VectorAssembler(inputCols=names, outputCol="features").transform(rows.filter("part <> 'val'").join(features, ["s1_id", "other_id"]))
    spark = joined.sparkSession
    joined = joined.select("features", "label", (F.col("part") == "stop").alias("stop")).repartition(spark.sparkContext.defaultParallelism)
    # written once: counting, splitting and fitting would each join anew
    joined.write.parquet(at := cache.fresh_path(spark, "training"))
    cache.release(spark)
    joined = spark.read.parquet(at)
    counts = {(r["label"], r["stop"]): r["count"] for r in joined.groupBy("label", "stop").count().collect()}
    size = sum(n for (_, stop), n in counts.items() if not stop)
    if not counts.get((1.0, False)) or not counts.get((0.0, False)):
        return None
    early = size >= TINY and counts.get((1.0, True)) and counts.get((0.0, True))
    options = {"validationIndicatorCol": "stop", "maxIter": trees} if early else {"maxIter": min(trees, TINY_TREES)}
    booster = GBTClassifier(stepSize=0.05, maxDepth=6 if early else 4, minInstancesPerNode=50 if early else 1, subsamplingRate=0.8, featureSubsetStrategy="0.9", seed=seed, **options)
    model = booster.fit(joined if early else joined.filter("NOT stop"))
    cache.release(spark)  # of hundreds of small jobs
    return model


def score(model, features: DataFrame) -> DataFrame:
    """s1_id, other_id, score of every row of features; 0 without a model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return features.select("s1_id", "other_id", F.lit(0.0).alias("score"))
    names = [c for c in features.columns if c not in ("s1_id", "other_id")]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(features).select("s1_id", "other_id", "features")
    return model.transform(rows).select("s1_id", "other_id", vector_to_array("probability")[1].alias("score"))
