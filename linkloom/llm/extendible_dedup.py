"""Exact dedup over an extendible-hash index kept in shared files (DataFrame operations only).

* A key is xxhash64 of the text. Keys are counted first (eight bytes each, combined map-side); a key met once has no copy,
  so its text need not move at all.
* The directory is indexed by a key's leading bits. Starting from one bucket, an overfull bucket is split on its next bit;
  when its depth equals the directory's, the directory doubles. The driver sees counts by 2**MAX_DEPTH slots at most; buckets
  hold CAPACITY keys, or as many as a directory of that size needs for them all.
* The texts of keys met twice or more go to the bucket that the directory names. Copies are combined map-side (a hash
  aggregate on bucket, key and the text itself, which compares bytes), so a group of any size costs a row per map task.
* Owner tasks take ranges of (bucket, key). Different texts under one key form a chain: link counts them in byte order.
  The index (bucket, h, link, text, ...) is written by those ranges.
* A probe looks its bucket up in the directory, meets its chain there in a join on (bucket, key), and compares bytes with
  each link. Probes of heavy groups (more than 1/HEAVY_SHARE of all rows, hence under HEAVY_SHARE groups) meet that bounded
  list by key, length and SHA-256 in a broadcast instead, so a third of all rows under one text stays where it is; a
  heavy text equal in all of these to another link of its chain would stop the job with an error.

Defined cases: null text counts as empty; rows that repeat an id and its text are one document seen twice and get equal
results (survivors() keeps one of them); a null id is a document whose id sorts below all others; an empty table gives an
empty result; exact_dedup looks at no other columns, survivors() carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, with_ids

#: Keys a bucket should hold at most, and the bits that the directory may use at most (2**16 histogram rows).
CAPACITY = 4_096
MAX_DEPTH = 16
HEAVY_SHARE = 1_000


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int], dict[int, int]]:
    """Split overfull buckets, doubling the directory as needed.

    counts: entries by slot at max_depth. Returns the global depth, the bucket of each slot of the directory, and the
    depth of each bucket. A bucket at max_depth stays overfull: its entries are simply a longer sorted run.
    """
    depth, local, prefix = 0, {0: 0}, {0: 0}
    held = {0: dict(counts)}
    todo = [0]
    while todo:
        bucket = todo.pop()
        if sum(held[bucket].values()) <= capacity or local[bucket] >= max_depth:
            continue
        depth = max(depth, local[bucket] + 1)  # a bucket as deep as the directory doubles it
        sibling = len(local)
        local[bucket] += 1
        local[sibling] = local[bucket]
        prefix[bucket], prefix[sibling] = 2 * prefix[bucket], 2 * prefix[bucket] + 1
        bit = max_depth - local[bucket]
        entries = held.pop(bucket)
        held[bucket] = {s: n for s, n in entries.items() if not s >> bit & 1}
        held[sibling] = {s: n for s, n in entries.items() if s >> bit & 1}
        todo += [bucket, sibling]
    slots = [0] * (1 << depth)
    for bucket, bits in local.items():
        width = 1 << depth - bits
        slots[prefix[bucket] * width : (prefix[bucket] + 1) * width] = [bucket] * width
    return depth, slots, local


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _slot(depth: int) -> Column:
    return (F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0)).cast("long")


class Index:
    """The directory and the keys of docs that several rows share."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
        spark, self.docs = docs.sparkSession, docs
        keys = docs.select(F.xxhash64(_text()).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.keys = materialize(keys, "hash-keys")
        counts = {r["slot"]: (r["keys"], r["rows"]) for r in self.keys.groupBy(_slot(max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).collect()}
        total = sum(k for k, _ in counts.values())
        self.depth, slots, _ = grow_directory({s: k for s, (k, _) in counts.items()}, max(capacity, 4 * total >> max_depth), max_depth)
        self.directory = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket long")  # at most 2**max_depth rows
        self.rows = sum(n for _, n in counts.values())

    def placed(self, df: DataFrame) -> DataFrame:
        """df(h, ...) with the bucket that the directory gives for h."""
        return df.withColumn("slot", _slot(self.depth)).join(F.broadcast(self.directory), "slot").drop("slot")

    def shared(self, *columns: str) -> DataFrame:
        """bucket, h, text and columns of the rows whose key others have too."""
        rows = self.docs.select(*columns, _text().alias("text"), F.xxhash64(_text()).alias("h"))
        return self.placed(with_ids(rows, self.keys.select("h"), "h", "left_semi"))

    def single(self, df: DataFrame) -> DataFrame:
        """The rows of df(h, ...) whose key no other row has."""
        return with_ids(df, self.keys.select("h"), "h", "left_anti")


def build_index(index: Index) -> DataFrame:
    """bucket, h, link, text, keep_id, group_size of each text whose key several rows have, written by ranges of (bucket, h)."""
    entries = index.shared("doc_id").groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = entries.repartitionByRange("bucket", "h")
    chained = owned.withColumn("link", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text")))
    return materialize(chained.select("bucket", "h", "link", "text", "keep_id", "group_size"), "hash-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, heavy_share: int = HEAVY_SHARE, least: int = 1_000) -> DataFrame:
    """doc_id, keep_id (largest id among equal texts), group_size, kept, text_sha256; one row per input row."""
    index = Index(docs, capacity, max_depth)
    chains = build_index(index)
    heavy_from = max(least, index.rows // heavy_share)
    sha = lambda: F.sha2(F.col("text").cast("binary"), 256)
    name = F.struct(F.length("text").alias("n"), sha().alias("sha"))
    hot = chains.filter(F.col("group_size") > heavy_from).select("h").distinct()  # under heavy_share keys
    listed = chains.join(F.broadcast(hot), "h").select("h", name.alias("name"), "keep_id", "group_size")
    clash = F.raise_error(F.lit("two different texts share xxhash64, length and SHA-256"))
    listed = listed.groupBy("h", "name").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("links"))
    listed = listed.select("h", "name", F.when(F.col("links") == 1, F.col("keep_id")).otherwise(clash).alias("keep_id"), "group_size")
    shown = ["doc_id", "keep_id", "group_size", "text_sha256"]

    rows = docs.select("doc_id", _text().alias("text"), F.xxhash64(_text()).alias("h"))
    alone = index.single(rows).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), sha().alias("text_sha256"))
    probes = index.shared("doc_id")
    known = probes.join(F.broadcast(hot), "h", "left_semi").withColumn("name", name).join(F.broadcast(listed), ["h", "name"])
    known = known.select("doc_id", "keep_id", "group_size", F.col("name.sha").alias("text_sha256"))
    link = chains.select(F.col("bucket"), F.col("h"), F.col("text").alias("held"), "keep_id", "group_size").join(F.broadcast(hot), "h", "left_anti")
    met = probes.join(F.broadcast(hot), "h", "left_anti").join(link.hint("merge"), ["bucket", "h"]).filter(F.col("text") == F.col("held"))
    met = met.select("doc_id", "keep_id", "group_size", sha().alias("text_sha256"))
    out = alone.select(*shown).union(known.select(*shown)).union(met.select(*shown))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, columns: tuple[str, ...], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row of docs for each distinct text, that of the largest id, with these columns (doc_id and text among them).

    A null text and an empty one are equal. Rows equal in id and text are one of them at random if equal, else that of
    the largest other columns. Rows are chosen as wholes: nothing is joined back by id.
    """
    index = Index(docs, capacity, max_depth)
    others = [c for c in columns if c not in ("doc_id", "text")]
    rows = docs.select(*columns, F.xxhash64(_text()).alias("h"))
    alone = index.single(rows).select(*columns)
    rows = with_ids(rows, index.keys.select("h"), "h", "left_semi").select("h", _text().alias("key"), F.col("text").isNotNull().alias("real"), "doc_id", *others)
    best = index.placed(rows).groupBy("bucket", "h", "key").agg(F.max(F.struct("doc_id", "real", *others)).alias("row"))
    text = F.when(F.col("row.real"), F.col("key"))
    return alone.union(best.select(*[text.alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in columns]))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
