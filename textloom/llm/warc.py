"""WARC archives: writing, reading, and revisit resolution by payload digest."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, partitions, remove, shared_folder, tidy

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload of an archive, and records in it at most.
ARCHIVE_BYTES, RECORDS_A_FILE = 64 << 20, 10_000
#: Bytes that are inflated at once when an archive is read.
CHUNK = 1 << 20
NO_ID = -(1 << 63)
_HEADER = "record_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def record_urn(key: int | None) -> str:
    d = hashlib.sha256(f"textloom-record-{key}".encode()).hexdigest()
    return f"<urn:uuid:{d[:8]}-{d[8:12]}-5{d[13:16]}-a{d[17:20]}-{d[20:32]}>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of records: the payload's base-32 SHA-1, its size and its SHA-256, without the payload."""
    for b in batches:
        raw = [x.as_buffer() if x.is_valid else b"" for x in b.column("payload")]
        sha = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]
        yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("own"), pa.array(sha, pa.string()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["record_id", "own", "payload_digest", "_whole", "payload_bytes"])


def resolve_revisits(records: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``records`` (record_id long, uri, payload) with payload_digest, payload_bytes, record_type and refers_to.

    Headers alone are shuffled by digest; of records with equal payloads of at least ``least_bytes`` bytes, the one with
    the smallest record_id is the response and the others are revisits that refer to it. Smaller ones are all responses.
    Payloads are equal if their SHA-1, their SHA-256 and their size are. They are dealt by record, not by digest, so a
    payload that very many records share meets in no task. A null payload is empty. A record without an id comes last;
    repeated rows with the smallest id are all responses.
    """
    rows = records.select("record_id", "uri", F.coalesce("payload", F.lit("")).alias("payload")).select("*", F.xxhash64("record_id", "uri", "payload").alias("own"), F.coalesce("record_id", F.lit(NO_ID)).alias("key"))
    heads = rows.select("record_id", "own", "payload").mapInArrow(tidy(_digest), "record_id long, own long, payload_digest string, _whole binary, payload_bytes long")
    same = ["payload_digest", "_whole", "payload_bytes"]
    originals = heads.groupBy(*same).agg(F.min("record_id").alias("original")).select(*(F.col(c).alias(f"of{c}") for c in same), "original")
    decided = heads.groupBy("record_id", "own", *same).agg(F.lit(1)).join(originals, [F.col(c) == F.col(f"of{c}") for c in same])
    decided = decided.select(F.coalesce("record_id", F.lit(NO_ID)).alias("_key"), F.col("own").alias("_own"), "payload_digest", "payload_bytes", "original")
    size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    files = max(partitions(records.sparkSession), -(-size // archive_bytes))
    joined = rows.repartition(files, "own", "key").join(decided, (F.col("own") == F.col("_own")) & (F.col("key") == F.col("_key")))
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("original"))
    return joined.select(
        "record_id", "uri", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "payload_digest", "payload_bytes",
        F.when(revisit, F.col("original")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _line(name: str, value: object) -> str:
    return f"{name}: {re.sub(r'[\x00-\x1f\x7f]', ' ', str(value))}\r\n"


def http_head(size: int) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"


def render(record_id: int | None, uri: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: str | None, date: str) -> str:
    """A record without its closing line ends: a response holds an HTTP message with the payload, a revisit only its head; both have fresh headers."""
    block = http_head(size) + (payload or "" if kind != "revisit" else "")
    out = ["WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", record_urn(record_id)), _line("WARC-Date", date)]
    if record_id is not None:
        out.append(_line("X-Record-Key", record_id))
    if uri is not None:
        out.append(_line("WARC-Target-URI", uri))
    out += [_line("WARC-Payload-Digest", f"sha1:{digest}"), _line("X-Payload-Length", size)]
    if kind == "revisit":
        out += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", record_urn(refers_to)), _line("X-Refers-To-Key", refers_to)]
    out += [_line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", len(block.encode())), "\r\n", block]
    return "".join(out)


def _rendered(date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([render(*r, date) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], names=["value"])

    return run


def write_warc(resolved: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE, date: str | None = None) -> None:
    """Gzipped archives below ``path``, written and committed by Spark; every record ends with two line ends. ``date`` is that of all records, now if none is given."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolved.select("record_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload").mapInArrow(tidy(_rendered(date)), "value string")
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """An archive's text in pieces; one or several gzip members, or plain."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + CHUNK]) for k in range(0, len(data), CHUNK))
        return
    while len(view):
        stream = zlib.decompressobj(wbits=31)
        while not stream.eof:
            if not len(view) and not stream.unconsumed_tail:
                raise ValueError("an archive is cut off")
            piece = stream.unconsumed_tail or bytes(view[:CHUNK])
            if not stream.unconsumed_tail:
                view = view[CHUNK:]
            yield stream.decompress(piece, CHUNK)
        view = memoryview(stream.unused_data + bytes(view)) if stream.unused_data else view


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive's text; blocks are taken by Content-Length, one at a time is held."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        if (piece := next(source, None)) is None:
            return False
        held.extend(piece)
        return True

    while True:
        while len(held) < 2 and more():
            pass
        if not held:
            return
        if held.startswith(b"\r\n"):
            del held[:2]
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record is cut off")
        head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        last = end + 4 + int(head["Content-Length"])
        while len(held) < last:
            if not more():
                raise ValueError("a record is cut off")
        block = bytes(held[end + 4 : last])
        del held[:last]
        yield head, block


def _read(payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["record_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names[: 6 + payload])

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for head, block in parse_warc(inflated(content.as_buffer().to_pybytes())):
                    key, to = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"record {key}: the payload does not have its digest")
                    rows.append((key and int(key), head.get("WARC-Target-URI"), kind, digest, int(head["X-Payload-Length"]), to and int(to), *([body.decode()] if payload else [])))
                    size += len(body) if payload else 0
                    if len(rows) == 2000 or size >= 8 * CHUNK:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of archives that :func:`write_warc` wrote; response payloads are checked against their digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(tidy(_read(payload)), _HEADER + (", payload string" if payload else ""))


def page_records(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("uri"), F.col("html").cast("string").alias("payload"))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as deduplicated archives in the shared folder, reads them back and returns one row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives an empty result. Other columns
    than page_id, url and html are not read. A page larger than an archive is one by itself."""
    path = shared_folder(spark, "warc")
    write_warc(resolve_revisits(page_records(pages)), path)
    rows = cut(read_warc(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, path)
    return rows
