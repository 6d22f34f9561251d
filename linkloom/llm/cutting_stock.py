"""Packing by cutting-stock column generation.

A document's ids (with an end id) are cut into pieces of CAPACITY ids and a remainder; a full piece is a sequence of its
own. Remainders are packed:

1. the histogram of their lengths in classes of GRAIN ids (at most CAPACITY / GRAIN rows, whatever the corpus) goes to the
   driver;
2. a linear program over patterns (how many pieces of each class share a sequence) is solved by column generation: the
   revised simplex gives dual prices, an unbounded knapsack dynamic program over the capacity finds the pattern worth most,
   and the loop ends when none is worth more than one sequence;
3. pattern counts are rounded down; the few pieces left over are packed first-fit, falling;
4. pieces are ranked within their class and each rank maps to its pattern's copies by range arithmetic. A lane is the task
   that cut the piece, so lanes grow with the input; ranks come from counts by (class, lane);
5. as cuts are free, the program's waste is filled: the least filled sequences, as many as all gaps together hold, are taken
   apart, their pieces laid end to end as one ribbon, and the ribbon is cut at the gaps of the sequences that stay (gaps
   under MIN_CUT ids are left as padding; what is left of the ribbon fills sequences of its own). Ribbon and gaps are
   running totals by lane, and meet in a join on cells of CAPACITY ids that either side touches twice at most.

Defined cases: null or empty text is the end id alone; repeated rows are documents of their own (sequence and offset differ);
a null doc_id is a document like any other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, sliced, starts, with_ids
from .tokens import TEXTS, encoder, vocabulary

CAPACITY = 2048
GRAIN = 8
END_ID = 1
#: Smallest gap that is filled by a cut.
MIN_CUT = 8
#: Sequences whose gaps one task adds up.
SEQUENCE_LANE = 1 << 12


def price(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the worth and content of the best pattern; item i (0-based) takes i + 1 units."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1][: len(values)][:room] + values[:room]
        i = int(np.argmax(worth))
        best[room], choice[room] = best[room - 1], -1
        if worth[i] > best[room] + 1e-12:
            best[room], choice[room] = worth[i], i
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            i = int(choice[room])
            pattern[i] = pattern.get(i, 0) + 1
            room -= i + 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 2_000) -> list[tuple[dict[int, int], float]]:
    """Patterns and fractional counts of the linear program; demand[i] pieces take i + 1 of capacity units each."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m, back = len(classes), {int(c): k for k, c in enumerate(classes)}
    patterns = [{int(c): capacity // (int(c) + 1)} for c in classes]
    count = demand[classes] / np.array([capacity // (int(c) + 1) for c in classes])
    inverse = np.diag([1.0 / (capacity // (int(c) + 1)) for c in classes])
    for _ in range(rounds):
        dual = inverse.sum(0)  # every pattern costs one sequence
        values = np.full(int(classes[-1]) + 1, -1.0)
        values[classes] = dual
        worth, pattern = price(values, capacity)
        if worth <= 1 + 1e-7:
            break
        column = np.zeros(m)
        for c, n in pattern.items():
            column[back[c]] = n
        step = (inverse * column).sum(1)  # small: plain loops beat a threaded BLAS here
        ratio = np.where(step > 1e-9, count / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= step[out]
        count[out] = ratio[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        count[others] = np.maximum(count[others] - step[others] * ratio[out], 0)
        patterns[out] = pattern
    return list(zip(patterns, count.tolist()))


def plan(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns and copies that hold every piece of demand."""
    left = demand.astype(np.int64).copy()
    chosen = []
    for pattern, count in solve(demand, capacity):
        n = min([int(count + 1e-9), *(int(left[c] // k) for c, k in pattern.items())])
        if n > 0:
            chosen.append((pattern, n))
            for c, k in pattern.items():
                left[c] -= n * k
    while left.any():  # first fit, falling, for what rounding left
        room, pattern = capacity, {}
        for c in np.flatnonzero(left)[::-1]:
            k = int(min(left[c], room // (c + 1)))
            if k:
                pattern[int(c)] = k
                room -= k * (int(c) + 1)
        n = min(int(left[c] // k) for c, k in pattern.items())
        chosen.append((pattern, n))
        for c, k in pattern.items():
            left[c] -= n * k
    return chosen


def take_apart(chosen: list[tuple[dict[int, int], int]], mean: dict[int, float], capacity: int, least: int = MIN_CUT) -> list[tuple[dict[int, int], int, bool]]:
    """(pattern, copies, apart): the least filled copies, as many as hold all gaps together, are to be taken apart.

    mean: average length of each class's pieces in ids.
    """
    fill = [(sum(k * mean[c] for c, k in pattern.items()), pattern, n) for pattern, n in chosen]
    spare = int(sum(n * (capacity - f) for f, _, n in fill if capacity - f >= least) // capacity)
    out = []
    for _, pattern, n in sorted(fill, key=lambda x: x[0]):
        m = min(n, spare)
        spare -= m
        out += [(pattern, count, apart) for count, apart in ((m, True), (n - m, False)) if count]
    return out


def pieces(docs: DataFrame, capacity: int, grain: int, end_id: int, path: str, cached: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids, kind, lane, at: full pieces (kind -1) and the remainder of each document.

    kind is the length's class, lane the task, at the piece's number among those of its kind and lane.
    """
    import pyarrow as pa

    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "lane", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, lane, met = encoder(path, cached).encode_batch, TaskContext.get().partitionId(), {}
        for batch in sliced(batches, TEXTS):
            rows, ids_ = [], []
            for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                data = ids + end
                n = len(data) // 4
                for a in range(0, n, capacity):
                    b = min(n, a + capacity)
                    kind = -1 if b - a == capacity else (b - a - 1) // grain
                    at = met.get(kind, 0)
                    met[kind] = at + 1
                    part = data[4 * a : 4 * b]
                    rows.append((i, a, b - a, zlib.crc32(part), n, kind, lane, at))
                    ids_.append(part if kind >= 0 else None)
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_, pa.binary())], [*names, "ids"])

    schema = ", ".join(f"{n} long" for n in names) + ", ids binary"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def _cells(df: DataFrame, at: str, size: str, capacity: int) -> DataFrame:
    """df once for each cell of capacity positions that [at, at + size) touches."""
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(at) / capacity), F.floor((F.col(at) + F.col(size) - 1) / capacity))))


def _cut(ribbon: DataFrame, used: DataFrame, base: int, capacity: int, least: int) -> DataFrame:
    """The pieces of ribbon cut at the gaps of used(sequence_id, used); base is the first sequence of the ribbon's rest."""
    spark = ribbon.sparkSession
    order = Window.partitionBy("lane").orderBy("kind", "at").rowsBetween(Window.unboundedPreceding, -1)
    ribbon = materialize(ribbon.withColumn("inner", F.coalesce(F.sum("length").over(order), F.lit(0))), "ribbon-lanes")
    lanes = starts(ribbon.groupBy("lane").agg(F.sum("length").alias("n")), "lane", "n")
    ribbon = materialize(ribbon.join(lanes, "lane").withColumn("pos", F.col("before") + F.col("inner")).select("doc_id", "start", "length", "doc_tokens", "ids", "pos"), "ribbon")
    gaps = used.withColumn("gap", capacity - F.col("used")).filter(F.col("gap") >= least).withColumn("lane", F.floor(F.col("sequence_id") / SEQUENCE_LANE))
    gaps = materialize(gaps, "open-sequences")
    order = Window.partitionBy("lane").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    lanes = starts(gaps.groupBy("lane").agg(F.sum("gap").alias("n")), "lane", "n")
    gaps = gaps.withColumn("inner", F.coalesce(F.sum("gap").over(order), F.lit(0))).join(lanes, "lane").withColumn("gpos", F.col("before") + F.col("inner"))
    gaps = materialize(gaps.select("sequence_id", "used", "gap", "gpos"), "gaps")
    room, length = gaps.agg(F.sum("gap")).first()[0] or 0, ribbon.agg(F.sum("length")).first()[0] or 0
    more = spark.range(max(0, -(-(length - room) // capacity)))
    more = more.select((F.col("id") + base).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(capacity).cast("long").alias("gap"), (F.col("id") * capacity + room).alias("gpos"))
    met = _cells(ribbon, "pos", "length", capacity).join(_cells(gaps.union(more), "gpos", "gap", capacity), "cell")
    a, b = F.greatest("pos", "gpos"), F.least(F.col("pos") + F.col("length"), F.col("gpos") + F.col("gap"))
    met = met.withColumn("a", a).withColumn("b", b).filter((F.col("a") < F.col("b")) & (F.floor(F.col("a") / capacity) == F.col("cell")))
    size, skip = F.col("b") - F.col("a"), F.col("a") - F.col("pos")
    part = F.substring(F.col("ids"), (skip * 4 + 1).cast("int"), (size * 4).cast("int"))
    return met.select("doc_id", (F.col("start") + skip).alias("start"), size.alias("length"), F.crc32(part).alias("ids_crc32"), "doc_tokens", "sequence_id", (F.col("used") + F.col("a") - F.col("gpos")).alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, path: str | None = None, least: int = MIN_CUT, cached: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; cached is the number of units a worker keeps."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, grain, end_id, path or vocabulary(), cached), "pieces")
    by_kind = {r["kind"]: (r["n"], r["size"]) for r in cut.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).collect()}  # at most capacity / grain + 1 rows
    demand = np.zeros(capacity // grain, np.int64)
    for k, (n, _) in by_kind.items():
        if k >= 0:
            demand[k] = n
    base, used_ranks, spans = by_kind.get(-1, (0, 0))[0], {}, {-1: [(0, 1, 0)]}
    mean = {k: size / n for k, (n, size) in by_kind.items()}
    apart_any = False
    for pattern, n, apart in take_apart(plan(demand, capacity // grain), mean, capacity, least):
        for c, k in pattern.items():
            spans.setdefault(c, []).append((used_ranks.get(c, 0), k, -1 if apart else base))
            used_ranks[c] = used_ranks.get(c, 0) + n * k
        apart_any |= apart
        base += 0 if apart else n
    # rank r of a class falls in the last span that begins at or before it
    ranges = spark.createDataFrame([(c, sorted(v)) for c, v in spans.items()], "kind long, spans array<struct<s:long,k:long,b:long>>")
    first = materialize(starts(cut.groupBy("kind", "lane").agg(F.count(F.lit(1)).alias("n")), "lane", "n", ("kind",)), "first-ranks")
    ranked = with_ids(cut, first, ["kind", "lane"], "inner").withColumn("rank", F.col("before") + F.col("at")).join(F.broadcast(ranges), "kind")
    ranked = ranked.withColumn("span", F.element_at(F.filter("spans", lambda x: x["s"] <= F.col("rank")), -1))
    ranked = ranked.withColumn("sequence_id", (F.col("span.b") + F.floor((F.col("rank") - F.col("span.s")) / F.col("span.k"))).cast("long"))
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "kind", "rank").rowsBetween(Window.unboundedPreceding, -1)
    stay = ranked.filter("kind >= 0 AND span.b >= 0").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    stay = stay.select(*shown, "offset")
    whole = ranked.filter("kind = -1").select(*shown, F.lit(0).cast("long").alias("offset"))
    if not apart_any:
        return whole.union(stay)
    stay = materialize(stay, "placed")
    ribbon = ranked.filter("kind >= 0 AND span.b < 0").select("doc_id", "start", "length", "doc_tokens", "ids", "kind", "lane", "at")
    used = stay.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return whole.union(stay).union(_cut(ribbon, used, base, capacity, least))
