"""Where true pairs are lost: decomposition, taxonomy, traces, cap curves and plans, ranker and position checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions.lexicons import FAMILIES

from .blocking import KEY, other_order

CATEGORIES = ("EXACT_NAME", "HN_AND_STATE", "TRANSITIVE", "NONLATIN", "SHARED_TOKEN", "INITIALS", "ADDRESS", "NONE")
#: Upper edges of the histogram of products of lost pairs' smallest buckets; the first begins above the cap.
CAP_EDGES = (5_000, 20_000, 50_000, 100_000, 500_000)
EMISSIONS = ("s1 only", "other only", "both", "neither")
LEVELS = (7_500, 10_000, 15_000, 20_000, 30_000, 50_000, 100_000, 500_000)
PLAN_BUDGET = 540_000_000


def _both(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda p, key: records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pairs.join(side("a", "s1_id"), "s1_id").join(side("b", "other_id"), "other_id")


def decomposition(pairs: DataFrame, k: int) -> DataFrame:
    """fate, n: delivered within k, capped out beyond it, never generated."""
    fate = F.when(~F.col("found"), "never generated").when(F.col("rnk") < k, "delivered").otherwise("capped out")
    return pairs.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def _long_tokens(c: Column) -> Column:
    return F.filter(tx.tokens(c), lambda t: F.length(t) >= 4)


def miss_categories(pairs: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """s1_id, other_id, found, category of each true pair not delivered within k: the first rule that holds.

    TRANSITIVE: another delivered record of the entity has the counterpart's sorted name.
    """
    df = _both(pairs, records, ("name_sorted", "houseno", "state", "name_script", "name_initials", "addr_norm"))
    told = df.filter((F.col("rnk") < k) & (F.col("b_name_sorted") != "")).select("s1_id", "b_name_sorted", F.lit(True).alias("kin")).distinct()
    lost = df.filter(F.col("rnk") >= k).join(told, ["s1_id", "b_name_sorted"], "left")  # a lost pair is never its own witness
    same = lambda c: (F.col(f"a_{c}") != "") & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    share = lambda c: F.arrays_overlap(_long_tokens(F.col(f"a_{c}")), _long_tokens(F.col(f"b_{c}")))
    rules = (
        same("name_sorted"),
        same("houseno") & same("state"),
        F.col("kin").isNotNull(),
        F.col("b_name_script") != "latin",
        share("name_sorted"),
        same("name_initials") & (F.length("a_name_initials") >= 3),
        same("houseno") | same("state") | share("addr_norm"),
    )
    category = F.lit(CATEGORIES[-1])
    for name, rule in reversed(list(zip(CATEGORIES, rules))):
        category = F.when(rule, name).otherwise(category)
    return lost.select("s1_id", "other_id", "found", category.alias("category"))


def miss_taxonomy(categories: DataFrame) -> DataFrame:
    """category, n, never_generated, capped_out."""
    return categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("found")).alias("never_generated"), F.count_if("found").alias("capped_out"))


def examples(categories: DataFrame, raw: DataFrame, most: int = 2) -> DataFrame:
    """At most so many lost pairs of each category, by their ids, with both raw rows side by side."""
    order = Window.partitionBy("category").orderBy("s1_id", "other_id")
    first = categories.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    shown = _both(first, raw, ("business_name", "business_address", "country"))
    return shown.select("category", "s1_id", "other_id", *[c for c in shown.columns if c[:2] in ("a_", "b_")])


def old_versus_new(pairs: DataFrame, old: DataFrame, k: int) -> DataFrame:
    """in_old, in_new, n of true pairs: kept by an older candidate list, delivered within k by this pool."""
    held = old.select("s1_id", "other_id", F.lit(True).alias("kept"))
    joined = pairs.join(held, ["s1_id", "other_id"], "left")
    return joined.groupBy(F.col("kept").isNotNull().alias("in_old"), (F.col("rnk") < k).alias("in_new")).agg(F.count(F.lit(1)).alias("n"))


def traces(pairs: DataFrame, keys: DataFrame, buckets: DataFrame, cap: int, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """s1_id, other_id, reason, min_pc, best_family of each true pair never generated.

    Of the keys both rows have, the one of the smallest bucket tells: CAP where even that is over the cap, BUG (a bucket that
    the budget or the join lost) where it is not; NOKEY without a common key. Ties go to the first family.
    """
    lost = pairs.filter("NOT found").select("s1_id", "other_id").distinct()
    side = lambda who: keys.select(F.col("entity_id").alias(who), *KEY).distinct()
    met = lost.join(side("s1_id"), "s1_id").join(side("other_id"), ["other_id", *KEY])
    met = met.withColumn("other_source", F.substring("other_id", 2, 1).cast("int")).join(buckets.select(*KEY, "other_source", "pc"), [*KEY, "other_source"])
    rank = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    best = met.groupBy("s1_id", "other_id").agg(F.min(F.struct("pc", rank.alias("r"), "family")).alias("best"))
    reason = F.when(F.col("best").isNull(), "NOKEY").when(F.col("best.pc") > cap, "CAP").otherwise("BUG")
    return lost.join(best, ["s1_id", "other_id"], "left").select("s1_id", "other_id", reason.alias("reason"), F.col("best.pc").alias("min_pc"), F.col("best.family").alias("best_family"))


def trace_reasons(trace: DataFrame) -> DataFrame:
    return trace.groupBy("reason", F.coalesce("best_family", F.lit("")).alias("best_family")).agg(F.count(F.lit(1)).alias("n"))


def cap_histogram(trace: DataFrame, edges: tuple[int, ...] = CAP_EDGES) -> DataFrame:
    """low, high (null: open), n of the CAP traces with low < min_pc <= high."""
    low = F.lit(0)
    for e in edges:
        low = F.when(F.col("min_pc") > e, e).otherwise(low)
    high = F.lit(None).cast("int")
    for e in reversed(edges):
        high = F.when(F.col("min_pc") <= e, e).otherwise(high)
    return trace.filter("reason = 'CAP'").groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"))


def nokey_matrix(trace: DataFrame, keys: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """family, emission, n: which side of the NOKEY pairs has any key of a family."""
    lost = trace.filter("reason = 'NOKEY'").select("s1_id", "other_id", F.explode(F.array(*map(F.lit, families))).alias("family"))
    has = keys.select("entity_id", "family").distinct()
    side = lambda who: has.select(F.col("entity_id").alias(who), "family", F.lit(True).alias(f"has_{who}"))
    both = lost.join(side("s1_id"), ["s1_id", "family"], "left").join(side("other_id"), ["other_id", "family"], "left")
    a, b = F.col("has_s1_id").isNotNull(), F.col("has_other_id").isNotNull()
    emission = F.when(a & b, EMISSIONS[2]).when(a, EMISSIONS[0]).when(b, EMISSIONS[1]).otherwise(EMISSIONS[3])
    return both.groupBy("family", emission.alias("emission")).agg(F.count(F.lit(1)).alias("n"))


def cap_curve(buckets: DataFrame, pairs: DataFrame, trace: DataFrame, caps: tuple[int, ...], full: int) -> DataFrame:
    """cap, volume, over, coverage, saved: pairs under each cap and true pairs then in the pool."""
    grid = F.broadcast(buckets.sparkSession.createDataFrame([(c,) for c in caps], "cap long"))
    volume = buckets.groupBy("pc").agg(F.sum("pc").alias("volume")).crossJoin(grid).groupBy("cap").agg(F.coalesce(F.sum(F.when(F.col("pc") <= F.col("cap"), F.col("volume"))), F.lit(0)).alias("volume"))
    lost = trace.filter("reason = 'CAP'").groupBy("min_pc").agg(F.count(F.lit(1)).alias("n"))
    saved = grid.join(lost, F.col("min_pc") <= F.col("cap"), "left").groupBy("cap").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("saved"))
    true = F.broadcast(pairs.agg(F.count(F.lit(1)).alias("n_true"), F.count_if("found").alias("n_found")))
    coverage = F.round((F.col("n_found") + F.col("saved")) / F.greatest("n_true", F.lit(1)), 6)
    return volume.join(saved, "cap").crossJoin(true).select("cap", "volume", (F.col("volume") > full).alias("over"), coverage.alias("coverage"), "saved")


def level_table(buckets: DataFrame, trace: DataFrame, cap: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """family, level, volume, saved: pairs of the family at each level, and its CAP pairs that the level brings back."""
    spark = buckets.sparkSession
    grid = F.broadcast(spark.createDataFrame([(v,) for v in (cap, *levels)], "level long"))
    by_pc = buckets.groupBy("family", "pc").agg(F.sum("pc").alias("v"))
    volume = by_pc.crossJoin(grid).groupBy("family", "level").agg(F.coalesce(F.sum(F.when(F.col("pc") <= F.col("level"), F.col("v"))), F.lit(0)).alias("volume"))
    lost = trace.filter("reason = 'CAP'").groupBy(F.col("best_family").alias("family"), "min_pc").agg(F.count(F.lit(1)).alias("n"))
    saved = lost.crossJoin(grid).groupBy("family", "level").agg(F.sum(F.when(F.col("min_pc") <= F.col("level"), F.col("n")).otherwise(0)).alias("saved"))
    return volume.join(saved, ["family", "level"], "left").fillna(0, ["saved"])


def greedy_plan(table: dict[tuple[str, int], tuple[int, int]], cap: int, levels: tuple[int, ...], budget: int) -> dict[str, int]:
    """A cap per family: from cap on, the family and level with most saved pairs per added pair is raised, within budget."""
    families = sorted({f for f, _ in table}, key=FAMILIES.index)
    caps = dict.fromkeys(families, cap)
    spent = sum(table[f, cap][0] for f in families)
    while spent < budget:
        best = None
        for f in families:
            for level in sorted(levels):
                more, saved = (table[f, level][i] - table[f, caps[f]][i] for i in (0, 1))
                if level > caps[f] and more > 0 and saved > 0 and spent + more <= budget and (best is None or saved / more > best[0]):
                    best = (saved / more, f, level, more)
        if not best:
            break
        caps[best[1]] = best[2]
        spent += best[3]
    return caps


def cap_plan(levels_of: DataFrame, cap: int, levels: tuple[int, ...] = LEVELS, budget: int = PLAN_BUDGET) -> DataFrame:
    """family, cap of greedy_plan over level_table; the loop runs on the driver over families x levels rows."""
    table = {(r["family"], r["level"]): (r["volume"], r["saved"]) for r in levels_of.collect()}
    return levels_of.sparkSession.createDataFrame(list(greedy_plan(table, cap, levels, budget).items()), "family string, cap long")


def old_and_new_ranks(pool: DataFrame) -> DataFrame:
    """pool with old_rank (by the better of both scores, then the counterpart's place) and ties (equal better scores of the entity)."""
    better = F.greatest("pri", "sec")
    order = Window.partitionBy("s1_id").orderBy(better.desc(), *other_order())
    return pool.withColumn("old_rank", (F.row_number().over(order) - 1).cast("int")).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("s1_id", F.round(better, 9))))


def ranker_check(pool: DataFrame, stored: DataFrame, categories: DataFrame, k: int) -> DataFrame:
    """One row on the capped-out pairs of equal names: how ties bury them, and whether the new order brings them within k.

    stored(s1_id, other_id, score): the older score as kept; mismatch counts those that differ from the recomputed one.
    """
    ranks = old_and_new_ranks(pool).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("s1_id")))
    mine = categories.filter("found AND category = 'EXACT_NAME'").select("s1_id", "other_id")
    rows = ranks.join(mine, ["s1_id", "other_id"], "left_semi").join(stored, ["s1_id", "other_id"])
    off = F.abs(F.col("score") - F.greatest("pri", "sec")) > 1e-6
    median = lambda c: F.percentile(c, 0.5)
    out = rows.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(off).alias("mismatch"), median("size").alias("median_candidates"), median("ties").alias("median_ties"),
        median("old_rank").alias("median_old"), median("rnk").alias("median_new"), F.count_if(F.col("rnk") < k).alias("fixed"),
    )
    verdict = F.when(F.col("samples") == 0, "NO SAMPLES").when(F.col("mismatch") > 0.01 * F.col("samples"), "ALIGNMENT BUG").when(F.col("fixed") >= 0.7 * F.col("samples"), "TIES CONFIRMED").otherwise("NOT TIES")
    return out.withColumn("verdict", verdict)


def position_leak(truth: DataFrame, positions: DataFrame, seed: int = 42) -> DataFrame:
    """source, n, corr, gap, gap_shuffled, exact, near, near_shuffled, red: whether a pair's places in its files tell it.

    Places are scaled to 0..1 over the number of S1 rows (the S1 side) and of the counterpart's file; shuffled partners
    are those of the pair next by a hash.
    """
    sized = positions.withColumn("source", F.substring("entity_id", 2, 1).cast("int"))
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    scaled = sized.join(F.broadcast(sizes), "source").select("entity_id", "source", "n", "position", (F.col("position") / F.greatest(F.col("n") - 1, F.lit(1))).alias("at"))
    a = scaled.select(F.col("entity_id").alias("s1_id"), F.col("at").alias("u"))
    b = scaled.select(F.col("entity_id").alias("other_id"), "source", F.col("at").alias("v"), "position", "n")
    pairs = truth.join(a, "s1_id").join(b, "other_id")
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), "s1_id", "other_id"))
    # the next pair by hash, within 256 lanes of the hash, so that no task holds all pairs
    lane = Window.partitionBy("source", F.substring(mixed, 1, 2)).orderBy(mixed, "s1_id", "other_id")
    pairs = pairs.withColumn("w", F.coalesce(F.lead("v").over(lane), F.first("v").over(lane))).withColumn("q", F.coalesce(F.lead("position").over(lane), F.first("position").over(lane)))
    guess = F.rint(F.col("u") * (F.col("n") - 1))
    near = lambda c: F.round(F.avg((F.abs(guess - F.col(c)) <= 2).cast("double")), 6)
    out = pairs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("u", "v"), 6).alias("corr"), F.round(F.avg(F.abs(F.col("u") - F.col("v"))), 6).alias("gap"), F.round(F.avg(F.abs(F.col("u") - F.col("w"))), 6).alias("gap_shuffled"),
        F.round(F.avg((guess == F.col("position")).cast("double")), 6).alias("exact"), near("position").alias("near"), near("q").alias("near_shuffled"),
    )
    return out.withColumn("red", (F.abs("corr") > 0.2) | (F.col("near") > 0.01) | (F.col("near_shuffled") > 0.001))
