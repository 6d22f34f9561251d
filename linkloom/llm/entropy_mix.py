"""Mixing sources to target token counts by entropy balancing (DataFrame operations only).

Targets: sources in code-point order, null last, carry WEIGHTS in turn and share the total; a target stops at MAX_COPIES
times its source and the excess goes to the others by weight (a prefix of the sources in order of cap over weight).

Rates: documents start at rate 1 and stay within 0..MAX_COPIES. The rates of least relative (bounded) entropy meeting each
source's token constraint are exponential tilts in the document's size, r = M / (1 + (M - 1) exp(-lambda x)), with
x = size over the source's mean size. lambda is the root of a convex dual; each Newton step is one distributed aggregate
over (source, size) counts and is kept inside a shrinking bracket. A source whose target is its cap takes rate M.

Copies: within blocks of about BLOCK documents of a source sizes are taken in falling order and the running shortfall is
rounded into whole copies, 0 to M each, so that an error is at most about half of the block's smallest document. A block
is a hash of id, size and a number among the rows that share both, so neither a source nor a row repeated any number of
times gathers in one block. No randomness: reruns agree.

Ranks of sources come from a range partitioning, and the level of the uncapped targets from aggregates over the sources,
repeated until no further source is capped, so no step puts all sources into one task.

Defined cases: null text has size 0 and takes 0; sources of size 0 have target 0; null source is a source of its own;
repeated rows are documents of their own; a null id is a document like any other; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranked

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 1_000
#: Newton steps, and rounds of capping, after which an unfinished search is an error.
STEPS = 400
#: A table of sources is broadcast only up to this many rows.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Runs without ASCII white space."""
    trimmed = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    return F.size(F.filter(F.split(trimmed, " ", -1), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MAX_COPIES, steps: int = STEPS) -> DataFrame:
    """sk, source_size, docs, target, limit for each source of sizes(sk, source, source_size, docs)."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    df = ranked(sizes, [F.col("source").isNull().asc(), F.col("source").asc_nulls_last()], "source-ranks")
    df = df.withColumn("w", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(cap))
    df = df.withColumn("ratio", F.col("limit") / F.col("w"))
    level = 0.0
    for _ in range(steps):  # the level rises until no source under it is left uncapped
        capped = F.col("ratio") <= level
        r = df.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("limit"))).alias("taken"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        new = (r["all"] - (r["taken"] or 0.0)) / r["w"] if r["w"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    else:
        raise RuntimeError(f"targets still change after {steps} rounds")
    target = F.when(F.col("ratio") <= level, F.col("limit")).otherwise(F.col("w") * level)
    return df.select("sk", "source_size", "docs", target.alias("target"), "limit")


def _near(df: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    return df.join(F.broadcast(table) if small else table, "sk")


def tilt(counts: DataFrame, targets: DataFrame, cap: int, small: bool, steps: int = STEPS) -> DataFrame:
    """sk, lam (null where the target is the cap), found by Newton iterations on the dual."""
    m = float(cap)
    goal = targets.filter("source_size > 0 AND target < limit * (1 - 1e-9)").select("sk", "target", (F.col("source_size") / F.col("docs")).alias("mean"))
    unknown = F.lit(None).cast("double")
    state = goal.select("*", F.lit(0.0).alias("lam"), unknown.alias("low"), unknown.alias("high"), F.lit(False).alias("done"))
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = m / (1 + (m - 1) * F.exp(-F.col("lam") * x))
        sums = _near(counts, state.filter("NOT done"), small).groupBy("sk").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / m)).alias("slope")
        )
        now = state.join(sums, "sk", "left").withColumn("gap", F.col("target") - F.col("got"))
        now = now.withColumn("low", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("high")))
        now = now.withColumn("newton", F.col("lam") + F.try_divide(F.col("gap"), F.col("slope")))
        bounded = F.coalesce(F.col("newton") > F.col("low"), F.lit(True)) & F.coalesce(F.col("newton") < F.col("high"), F.lit(True))
        inside = F.coalesce(bounded & (F.abs(F.col("newton")) <= 16 * (1 + F.abs(F.col("lam")))), F.lit(False))
        # without a bound on the side to go to, the step grows fourfold; between two bounds it halves the bracket
        middle, far = (F.col("low") + F.col("high")) / 2, F.when(F.col("gap") > 0, 1.0).otherwise(-1.0) * (4 * F.abs(F.col("lam")) + 1)
        near = (F.abs(F.col("gap")) <= 1e-7 * F.col("target")) | F.coalesce(F.col("high") - F.col("low") <= 1e-12 * (1 + F.abs(F.col("lam"))), F.lit(False))
        stop = F.col("done") | near | F.col("got").isNull()
        state = materialize(now.select("sk", "target", "mean", F.when(stop, F.col("lam")).when(inside & F.col("newton").isNotNull(), F.col("newton")).otherwise(F.coalesce(middle, far)).alias("lam"), "low", "high", stop.alias("done")).coalesce(1), "tilt")
        if not state.filter("NOT done").limit(1).count():
            return state.select("sk", "mean", "lam")
    raise RuntimeError(f"the dual is not solved after {steps} steps")


def entropy_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MAX_COPIES, block: int = BLOCK, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, size, source_size, target, taken, copies; a row per input row."""
    m = float(cap)
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sized = materialize(docs.select(*key, "source", source.alias("sk"), word_count(F.col("text")).alias("size")), "sizes")
    counts = materialize(sized.groupBy("sk", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    stats = sized.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = materialize(source_targets(stats, weights, cap), "targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    lam = tilt(counts, targets, cap, small)
    plan = targets.join(lam, "sk", "left")
    equal = sized.groupBy(*key, "sk", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = equal.select(*key, "sk", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number"))
    rated = _near(sized, plan, small)
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("lam").isNull(), F.lit(m)).otherwise(m / (1 + (m - 1) * F.exp(-F.col("lam") * x)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / block))
    rated = rated.select(*key, "sk", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64(*key, "size", "number"), blocks).alias("block"))
    # rated in blocks: falling size, then key; owed carries the tokens still to be placed
    row = F.struct((-F.col("size")).alias("o"), *key, "size", "source_size", "target", "rate")
    group = rated.groupBy("sk", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.expr("named_struct('owed', cast(0 as double), 'copies', cast(array() as array<int>))")

    def place(state: Column, r: Column) -> Column:
        owed = state["owed"] + r["rate"] * r["size"]
        copies = F.when(r["size"] > 0, F.least(F.lit(cap), F.greatest(F.lit(0), F.floor(owed / r["size"] + 0.5).cast("int")))).otherwise(F.lit(0))
        return F.struct((owed - copies * r["size"]).alias("owed"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    placed = group.select(F.explode(F.arrays_zip("rows", F.aggregate("rows", zero, place, lambda s: s["copies"]).alias("copies"))).alias("z"))
    r, copies = F.col("z")["rows"], F.col("z")["copies"]
    return placed.select(*[r[k].alias(k) for k in key], r["size"].alias("size"), r["source_size"].alias("source_size"), r["target"].alias("target"), (copies * r["size"]).cast("long").alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, columns: tuple[str, ...], **options) -> DataFrame:
    """Each row of docs as many times as the mix takes it, with these columns (text and source among them).

    Rows are told apart by two hashes over all columns (128 bits), never by id; copies of rows equal in all columns are
    summed, so that one of them stands for all.
    """
    docs = docs.select(*columns, F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(1), *columns).alias("r2"))
    taken = entropy_mix(docs, key=("r1", "r2"), **options).filter("copies > 0").groupBy("r1", "r2").agg(F.sum("copies").alias("copies"))
    taken = materialize(taken, "copies")
    one = docs.dropDuplicates(["r1", "r2"]).join(taken, ["r1", "r2"])
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)
