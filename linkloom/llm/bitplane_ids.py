"""Token-id files with bit-plane or byte-plane shuffling.

A shard file holds chunks, then an index. A chunk is BLOCK ids (the last may be shorter) as unsigned 32-bit integers,
transposed into planes (32 bit planes, or 4 byte planes); all-zero planes are left out and each other plane is a Zstandard
frame. The index is a JSON document in a frame of its own: format, plane kind, and for each chunk its ids, place and plane
lengths; then the documents in order with their token counts. The last 16 bytes before the final mark give the index's
place. A document may span chunks.

Documents are dealt to shards by ranges of doc_id (sampled by Spark) and sorted within, so shards in order are documents
in ascending id order; there are as many as the session's shuffle partitions, unless a number is given. Start positions are
running totals of the shards' totals, in two levels.

Defined cases: null or empty text is the end id alone; repeated rows are written once each, in a tie broken by text; null ids
sort first; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, materialize, sliced, starts
from .raw_files import MARK, read_raw, write_raw
from .tokens import TEXTS, encoder, vocabulary

BLOCK = 1 << 16
END_ID = 2
_FORMAT = "bit-plane-ids-1"
_TAIL = struct.Struct("<QQ")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    return [np.packbits((raw[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            if bits:
                raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (k % 8)
            else:
                raw[:, k] = np.frombuffer(plane, np.uint8)
    return raw.reshape(-1).view("<u4")


def encode_chunk(ids: np.ndarray, bits: bool, level: int = 3) -> tuple[bytes, list[int]]:
    pack = zstandard.ZstdCompressor(level=level).compress
    frames = [pack(p) if p.strip(b"\0") else b"" for p in to_planes(ids, bits)]
    return b"".join(frames), [len(f) for f in frames]


def decode_chunk(data: bytes, lengths: list[int], n: int, bits: bool) -> np.ndarray:
    size, planes, at = (n + 7) // 8 if bits else n, [], 0
    unpack = zstandard.ZstdDecompressor().decompress
    for length in lengths:
        plane = unpack(data[at : at + length]) if length else b""
        if length and len(plane) != size:
            raise ValueError("a plane has the wrong length")
        planes.append(plane)
        at += length
    return from_planes(planes, n, bits)


def shard_blobs(docs: Iterator[tuple[int, bytes]], block: int = BLOCK, bits: bool = True) -> Iterator[bytes]:
    """The rows of one shard file for (doc_id, ids as bytes) in order; each is followed by MARK in the file."""
    held, size, place, chunks, index = [], 0, 0, [], []

    def chunk(data: bytes) -> bytes:
        nonlocal place
        ids = np.frombuffer(data, "<u4")
        blob, lengths = encode_chunk(ids, bits)
        chunks.append([len(ids), place, lengths])
        place += len(blob) + len(MARK)
        return blob

    for doc, data in docs:
        index.append([doc, len(data) // 4])
        held.append(data)
        size += len(data)
        if size >= 4 * block:
            joined = b"".join(held)
            for a in range(0, size - size % (4 * block), 4 * block):
                yield chunk(joined[a : a + 4 * block])
            rest = joined[size - size % (4 * block) :]
            held, size = [rest], len(rest)
    if size:
        yield chunk(b"".join(held))
    if index:
        head = zstandard.ZstdCompressor().compress(json.dumps({"format": _FORMAT, "bits": bits, "chunks": chunks, "docs": index}).encode())
        yield head + _TAIL.pack(place, len(head))


def read_shard(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(doc_id, ids as bytes) of a shard file, in order; fails on a file that is cut short or inconsistent."""
    if data[-len(MARK) :] != MARK:
        raise ValueError("the file is cut short")
    end = len(data) - len(MARK)
    place, length = _TAIL.unpack(data[end - _TAIL.size : end])
    if place + length + _TAIL.size != end:
        raise ValueError("the index is not where the file says")
    head = json.loads(zstandard.ZstdDecompressor().decompress(data[place : place + length]))
    if head["format"] != _FORMAT or sum(c[0] for c in head["chunks"]) != sum(d[1] for d in head["docs"]):
        raise ValueError("the index is inconsistent")
    chunks, held = iter(head["chunks"]), b""
    for doc, n in head["docs"]:
        parts, have = [held], len(held)
        while have < 4 * n:
            size, at, lengths = next(chunks)
            parts.append(decode_chunk(data[at : at + sum(lengths)], lengths, size, head["bits"]).tobytes())
            have += len(parts[-1])
        held = b"".join(parts) if len(parts) > 1 else held
        yield doc, held[: 4 * n]
        held = held[4 * n :]


def write_ids(docs: DataFrame, path: str, shards: int | None = None, bits: bool = True, end_id: int = END_ID, vocab: str | None = None, block: int = BLOCK, cached: int | None = None) -> None:
    """Tokenize docs and write shard files under path in ascending doc_id order."""
    import pyarrow as pa

    vocab, end = vocab or vocabulary(), np.array([end_id], "<u4").tobytes()
    full = docs.select(F.col("doc_id").cast("long"), "text")
    order = F.col("doc_id").asc_nulls_first()  # without a number the session's shuffle partitions hold
    dealt = (full.repartitionByRange(order) if shards is None else full.repartitionByRange(shards, order)).sortWithinPartitions(order, F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab, cached).encode_batch

        def rows() -> Iterator[tuple[int, bytes]]:
            for part in sliced(batches, TEXTS):
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    yield i, ids + end

        for blob in shard_blobs(rows(), block, bits):
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    write_raw(map_batches(dealt, run, "blob binary"), "blob", path)


def read_ids(spark, path: str) -> DataFrame:
    """path, position, doc_id, n_tokens and ids_crc32 of each document in the shard files."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                rows = [(i, len(ids) // 4, zlib.crc32(ids)) for i, ids in read_shard(data)] if data else []
                n = len(rows)
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["path", "position", "doc_id", "n_tokens", "ids_crc32"])

    return map_batches(read_raw(spark, path), run, "path string, position long, doc_id long, n_tokens long, ids_crc32 long")


def ids_round_trip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_ids(docs, path, **options)
    read = materialize(read_ids(spark, path), "ids-read")
    name = F.element_at(F.split("path", "/"), -1)  # part-NNNNN...: shards in order
    read = read.withColumn("shard", F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"))
    shards = starts(read.groupBy("shard").agg(F.sum("n_tokens").alias("total")), "shard", "total")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.withColumn("within", within).join(shards, "shard").select("doc_id", (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
