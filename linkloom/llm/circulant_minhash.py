"""MinHash near-dedup with circulant signatures: two permutations give all coordinates.

The first permutation scatters a shingle over 2**32 positions; coordinate k is the minimum, over a document's shingles, of
the second permutation after a circular shift by k. BANDS bands of ROWS coordinates make candidates; at similarity 0.8 a
pair shares no band with probability (1 - 0.8**6)**40, about 5e-6. Every link is confirmed by exact Jaccard on full sets.

Pairs are never expanded within a group:
1. documents with identical sets (by a 128-bit hash of the whole set) fall into one class, a node; nothing below looks at ids;
2. in each bucket every node is compared with one hub (the smallest node), then, if its component differs, with a
   second hub (the smallest under a hash);
3. what remains are buckets that still hold several components. A shingle that no other open node has cannot be shared, so
   nodes whose other shingles are too few for any link leave; cross-component pairs of the rest are joined under the same
   bound, a condition on sizes and one on 4096-bit sketches (low bits of circulant coordinates), which leaves only pairs
   near or above the threshold: one at similarity 0.8 is left out with a probability under 1e-9, since it would have to
   differ by six deviations. A pair is taken at its first common bucket alone.

Sets are of 64-bit shingle hashes; two sets under comparison hold a false common element with a probability of their sizes'
product over 2**64.

Defined cases: null text, or text without words, has an empty set, links with nothing and is kept; repeated rows with one
id get equal results; rows that share an id but not a text are documents of their own, each with its component's smallest
id; a null id is larger than any other, and a component of null ids alone has a null id; an empty table gives an empty
result; other columns are not looked at. survivors() keeps one whole row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, map_batches, materialize, sliced, with_ids
from .components import components
from .shingles import mix, shingle_arrays, shingle_set

BANDS, ROWS = 40, 6
SHINGLE = 5
THRESHOLD = 80
SKETCH = 4096
_PIECE = 1 << 15


def _scatter(h: np.ndarray) -> np.ndarray:
    """First permutation: positions on a circle of 2**32."""
    return (mix(h + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def circulant_signatures(hashes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """Signatures (documents, count) of concatenated non-empty sets that begin at offsets."""
    position = _scatter(hashes)
    out = np.empty((len(offsets), count), np.uint32)
    v, t = np.empty_like(position), np.empty_like(position)
    for k in range(count):
        np.add(position, np.uint32(k), out=v)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(v, np.uint32(shift), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint32(factor), out=v)
        np.right_shift(v, np.uint32(16), out=t)
        np.bitwise_xor(v, t, out=v)
        out[:, k] = np.minimum.reduceat(v, offsets)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(signatures), 0)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows].astype(np.uint64))
    return key.view(np.int64)


def _signed(docs: DataFrame, width: int, bands: int, rows: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, th (hash of the text), keys, n_shingles, set_key and band keys (empty for an empty set)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, n = batch.column(0).to_pylist(), batch.num_rows
            sizes, names, found_keys = np.zeros(n, np.int64), [b""] * n, np.zeros((n, bands), np.int64)
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if held:
                    offsets = np.concatenate(([0], np.cumsum([len(s) for _, s in held])[:-1]))
                    signed = circulant_signatures(np.concatenate([s for _, s in held]), offsets, bands * rows)
                    found_keys[[i for i, _ in held]] = band_keys(signed, bands, rows)
                    held.clear()

            waiting = 0
            for i, hashes, _ in shingle_arrays(texts, width):
                found = shingle_set(hashes)
                sizes[i] = len(found)
                names[i] = set_name(found)
                if len(found):
                    held.append((i, found))
                    waiting += len(found)
                    if waiting > _PIECE:
                        flush()
                        waiting = 0
            flush()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)), pa.array(found_keys[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes), pa.array(names, pa.binary()), lists], [*batch.schema.names[1:], "n_shingles", "set_key", "bands"])

    full = docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), *keys)
    return map_batches(full, run, ", ".join(f"{c} long" for c in ("doc_id", "th", *keys)) + ", n_shingles long, set_key binary, bands array<long>")


def set_name(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else b""


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """set_key and the packed sorted shingle hashes of each document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingle_set(h) for _, h, _ in shingle_arrays(batch.column(0).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["set_key", "members"])

    return map_batches(docs.select("text"), run, "set_key binary, members binary")


def _own(sets: DataFrame) -> DataFrame:
    """v, own: how many shingles of a set no other of these sets has."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(found) if found else owner, pa.int64())], ["v", "h"])

    single = map_batches(sets.select("v", "members"), run, "v long, h long").groupBy("h").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return single.groupBy("v").agg(F.count(F.lit(1)).alias("own"))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(100 * shared >= threshold * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("v").alias("a"), F.col("members").alias("p")), sets.select(F.col("v").alias("b"), F.col("members").alias("q"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q"), run, "a long, b long")


def _sketches(sets: DataFrame, bits: int) -> DataFrame:
    """v and the low bits of circulant coordinates, as columns s0, s1, ... of 64 bits."""
    import pyarrow as pa

    names = [f"s{k}" for k in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            words, a = np.empty((len(found), bits // 64), np.int64), 0
            while a < len(found):  # about _PIECE hashes at a time
                b, size = a + 1, len(found[a])
                while b < len(found) and size + len(found[b]) <= _PIECE:
                    size += len(found[b])
                    b += 1
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in found[a : b - 1]], dtype=np.int64)))
                low = circulant_signatures(np.concatenate(found[a:b]), offsets, bits) & np.uint32(1)
                words[a:b] = np.packbits(low.astype(np.uint8), axis=1).view(np.int64)
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(words[:, k]) for k in range(words.shape[1])]], ["v", *names])

    return map_batches(sets.select("v", "members"), run, "v long, " + ", ".join(f"{n} long" for n in names))


def most_different(threshold: int, bits: int) -> int:
    """Bits in which two sets at the threshold may differ, six deviations included."""
    p = (1 - threshold / 100) / 2
    return int(bits * p + 6 * (bits * p * (1 - p)) ** 0.5) + 1


def _grouped(docs: DataFrame, shingle: int, threshold: int, bands: int, rows: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and set_key, class_id, component, component_id of each class of equal sets."""
    signed = materialize(_signed(docs, shingle, bands, rows, keys), "signatures")
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    banded = classes.select("v", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    live = materialize(banded.join(shared, "key"), "buckets")
    known = materialize(classes.select("v", "set_key", F.coalesce("at.doc_id", F.lit(0)).alias("k"), "at.th").join(live.select("v").distinct(), "v", "left_semi"), "live-classes")
    named = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64("text").alias("th"))
    chosen = with_ids(named, known.select("k", "th").distinct(), ["k", "th"], "left_semi")
    sets = materialize(_sets(chosen, shingle).join(known.select("set_key", "v"), "set_key").select("v", "members").dropDuplicates(["v"]), "sets")

    close = (F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold)
    ordered = (F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b"))
    links = tested = parts = None
    for turn in range(3):
        named = live.withColumn("c", F.col("v")) if parts is None else live.join(parts, "v", "left").select("v", "n", "key", F.coalesce("component", "v").alias("c"))
        if turn < 2:
            order = F.col("v") if not turn else F.xxhash64("v")
            hubs = named.groupBy("key").agg(F.min(F.struct(order.alias("o"), "v", "n", "c")).alias("h"), F.min("c").alias("low"), F.max("c").alias("high"))
            hubs = hubs.filter("low < high").select("key", F.col("h.v").alias("hub"), F.col("h.n").alias("m"), F.col("h.c").alias("d"))
        else:
            open_keys = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
            named = materialize(named.join(open_keys, "key"), "open-keys")
            open_sets = sets.join(named.select("v").distinct(), "v", "left_semi")
            own = materialize(_own(open_sets), "own-shingles")
            named = named.join(own, "v", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).filter(F.col("s") * 100 >= F.col("n") * threshold).drop("own")
            sketches = materialize(_sketches(sets.join(named.select("v").distinct(), "v", "left_semi"), SKETCH), "sketches")
            held = named.groupBy("v").agg(F.collect_set("key").alias("keys"))  # at most one per band
            named = materialize(named.join(held, "v").join(sketches, "v"), "open-buckets")
            parts64 = [c for c in sketches.columns if c != "v"]
            hubs = named.select("key", F.col("v").alias("hub"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("s").alias("z"), F.col("keys").alias("okeys"), *[F.col(c).alias(f"o{c}") for c in parts64])
            apart = F.expr(" + ".join(f"bit_count({c} ^ o{c})" for c in parts64))
            most = F.least("s", "z")
            close = close & (F.col("v") < F.col("hub")) & (most * 100 >= (F.col("n") + F.col("m") - most) * threshold)
            close = close & (apart <= most_different(threshold, SKETCH)) & (F.array_min(F.array_intersect("keys", "okeys")) == F.col("key"))
        pairs = named.join(hubs, "key").filter((F.col("c") != F.col("d")) & close)
        pairs = pairs.select(*ordered).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialize(_confirmed(pairs, sets, threshold), "confirmed")
        new = found.limit(1).count() > 0
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if new:
            parts = components(links)
    classes = classes.select("set_key", "class_id", "v")
    if parts is None:
        return signed, classes.select("set_key", "class_id", F.col("v").alias("component"), F.col("class_id").alias("component_id"))
    joined = materialize(classes.join(parts, "v").select("set_key", "class_id", "component"), "linked-classes")
    ids = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    joined = joined.join(ids, "component").select("set_key", "class_id", "component", "component_id")
    single = with_ids(classes, parts.select("v"), "v", "left_anti").select("set_key", "class_id", F.col("v").alias("component"), F.col("class_id").alias("component_id"))
    return signed, materialize(joined.union(single), "components")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept; a row per input row."""
    signed, classes = _grouped(docs, shingle, threshold, bands, rows)
    shown = ["doc_id", "n_shingles", "class_id", "component_id"]
    member = signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(classes, "set_key").select(*shown)
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return member.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, columns: tuple[str, ...], shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of docs of each component, and every row without words, with these columns (doc_id and text among them).

    Of a component the row of the smallest id stays; among such rows the one whose hash over all columns is smallest. Rows
    are told apart by two such hashes (128 bits), never by id; of rows equal in all columns one stays.
    """
    docs = docs.select(*columns, F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(1), *columns).alias("r2"))
    signed, classes = _grouped(docs, shingle, threshold, bands, rows, ("r1", "r2"))
    member = signed.filter("n_shingles > 0").select("doc_id", "set_key", "r1", "r2").join(classes.select("set_key", "component"), "set_key")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    groups = materialize(member.groupBy("component").agg(F.min(row).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "best"), "groups")
    moved = member.join(groups, "component")
    lost = materialize(moved.filter((F.col("r1") != F.col("best.r1")) | (F.col("r2") != F.col("best.r2"))).select("r1", "r2").distinct(), "near-copies")
    repeated = materialize(moved.filter((F.col("r1") == F.col("best.r1")) & (F.col("r2") == F.col("best.r2"))).groupBy("r1", "r2").count().filter("count > 1").select("r1", "r2"), "repeated-rows")
    rest = with_ids(docs, lost, ["r1", "r2"], "left_anti")
    if not is_small(repeated, 0):
        once = with_ids(rest, repeated, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
        rest = with_ids(rest, repeated, ["r1", "r2"], "left_anti").union(once)
    return rest.select(*columns)
