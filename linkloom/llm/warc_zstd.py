"""WARC archives compressed with Zstandard: one frame per record, dictionary in a leading skippable frame.

Writing: payloads of at least a given size that are equal bytes share one response record, that of the smallest id; the rest
are revisit records naming it. An archive is a skippable frame (magic 0x184D2A5D) holding the dictionary, itself a
Zstandard frame, then a frame per record; a task closes an archive once it holds ARCHIVE_BYTES, so that none grows with
the task's share. Payloads stay where they are read: only (id, hash, size) rows are grouped, and revisits found by a
join on (id, hash) whose small side is broadcast when counted to be small. The dictionary is trained on at most SAMPLE_PAGES payloads chosen by a
hash of their ids, each cut to SAMPLE_BYTES for training alone.

Reading checks: the leading frame's magic and length, one whole frame per record with its declared content size, the version
line, required headers, Content-Length against the block, the blank lines at the end, the HTTP Content-Length against
the payload, and the payload digest of each response.

Defined cases: null html is an empty payload; rows that repeat an id and its payload are responses alike; a null id counts as
larger than any other, so it revisits one where there is one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, materialize, sliced, with_ids
from .raw_files import MARK, read_raw, write_raw

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SAMPLE_PAGES = 400
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 32_768
#: Compressed bytes after which an archive is closed; a single larger record is an archive of its own.
ARCHIVE_BYTES = 16 << 20
PAGES_PER_BATCH = 200
_RECORD = "urn:page:"
_FEED = 32_768


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; a raw-content one where there is too little to train on."""
    samples = [p for p in payloads if p]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n").ljust(64, b" ")


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of refers_to; both carry the HTTP headers of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_RECORD}{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_RECORD}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one decoded record; ValueError on anything malformed."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError("a malformed header line")
        if name.lower() in fields:
            raise ValueError("a header occurs twice")
        fields[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need} header")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    kind = fields["warc-type"]
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not blank or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("no HTTP Content-Length")
    size, name = int(sizes[0]), fields.get("warc-payload-digest", "")
    if kind == "response" and (len(payload) != size or name != f"sha1:{digest(payload)}"):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a malformed revisit record")
    return {"fields": fields, "type": kind, "payload": payload, "payload_bytes": size, "digest": name.removeprefix("sha1:")}


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise ValueError("the dictionary frame is cut short")
    body = data[8:at]
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    view = memoryview(data)
    while at < len(data):
        if data[at : at + len(MARK)] == MARK:  # an empty skippable frame
            at += len(MARK)
            continue
        size = zstandard.frame_content_size(data[at : at + 18])
        one, parts, fed = reader.decompressobj(), [], at
        while not one.eof and fed < len(data):
            parts.append(one.decompress(view[fed : fed + _FEED]))
            fed = min(len(data), fed + _FEED)
        out = b"".join(parts)
        if not one.eof or size != len(out):
            raise ValueError("a frame is cut short or has another size than it declares")
        at = fed - len(one.unused_data)
        yield parse_record(out)


def resolve(pages: DataFrame, least: int) -> DataFrame:
    """pages(page_id, url, payload) with refers_to: the smallest id with the same payload, if another's and not too small."""
    named = materialize(pages.select("page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("size")), "payload-names")
    groups = named.filter(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    moved = materialize(named.join(groups, "sha").filter("page_id <> first OR page_id IS NULL AND first IS NOT NULL").select("page_id", F.col("sha"), "first").distinct(), "revisits")
    # a null id is joined under a value of its own; the flag keeps it apart from every real id
    keyed = lambda df: df.withColumn("k", F.coalesce("page_id", F.lit(0))).withColumn("missing", F.col("page_id").isNull())
    out = with_ids(keyed(pages.withColumn("sha", F.sha2("payload", 256))), keyed(moved).drop("page_id"), ["k", "missing", "sha"], "left")
    return out.select("page_id", "url", "payload", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, limit: int = ARCHIVE_BYTES) -> None:
    """Write archives of about limit bytes at most from pages(page_id, url, html)."""
    import pyarrow as pa

    spark = pages.sparkSession
    full = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    chosen = full.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)  # ids alone go to the driver's sort
    rows = full.join(F.broadcast(chosen), "page_id").select("page_id", F.substring("payload", 1, SAMPLE_BYTES).alias("p")).dropDuplicates(["page_id"]).collect()
    sample = sorted(rows, key=lambda r: r["page_id"])
    dictionary = train_dictionary([record(r["page_id"], "", bytes(r["p"]), None) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, head = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)), dictionary_frame(dictionary)
        held, size = [head], len(head)
        shut = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
        for batch in sliced(batches, PAGES_PER_BATCH):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                frame = writer.compress(record(*row))
                if len(held) > 1 and size + len(frame) > limit:
                    yield shut()
                    held, size = [head], len(head)
                held.append(frame)
                size += len(frame)
        if len(held) > 1:
            yield shut()

    write_raw(map_batches(resolve(full, least), run, "archive binary"), "archive", path, rows_per_file=1)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record."""
    import pyarrow as pa

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    number = lambda s: int(s.strip("<>").removeprefix(_RECORD)) if s and s.strip("<>").removeprefix(_RECORD) != "None" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows = [(number(r["fields"]["warc-record-id"]), r["payload_bytes"], r["digest"], r["type"], number(r["fields"].get("warc-refers-to")), r["fields"].get("warc-target-uri", "")) for r in (read_archive(data) if data else ())]
                columns = list(zip(*rows)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return map_batches(read_raw(spark, path).select("content"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(pages: DataFrame, least: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, least, limit)
    return materialize(read_archives(pages.sparkSession, path), "warc-read")
