"""Exact dedup by Grace hash partitioning.

Two passes with the same routine. The first runs inside each input partition, so a text that a third of all rows
share leaves every partition once; the second runs over hash partitions of those representatives. Both fill an
open-addressing table that compares complete content; when the table is full, records of new content go to spill
files by the next bits of their hash, and each file is worked off the same way until it fits. What a pass says of a
partition does not depend on the order of its rows, so a task that runs again after a loss says the same.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, tidy, without_rows

#: Bytes of content, members and overhead in a table; a task has one table at a time.
TABLE_BYTES = 48 << 20
ENTRY_BYTES, MEMBER_BYTES = 300, 16
FAN_OUT_BITS = 4
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096
_HEAD = "<32sqqqqI"
NO_ID = -(1 << 63)


class OpenTable:
    """Distinct contents in an open-addressing table with linear probing."""

    def __init__(self) -> None:
        self.mask, self.slots = 1023, array("q", [-1]) * 1024
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        #: Of each content the largest id, of equal ones the least raw hash, then the least holder; and its rows.
        self.best: list[tuple[int, int, int]] = []
        self.counts: list[int] = []
        self.entries, self.holders = array("q"), array("q")
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> int:
        """The entry of this content, or ~slot where it would go."""
        i = int.from_bytes(digest[-8:], "little") & self.mask
        while (e := self.slots[i]) >= 0:
            if self.digests[e] == digest and self.contents[e] == content:
                return e
            i = (i + 1) & self.mask
        return ~i

    def insert(self, slot: int, digest: bytes, content: bytes, best: tuple[int, int, int]) -> int:
        e = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        self.best.append(best)
        self.counts.append(0)
        self.bytes += len(content) + ENTRY_BYTES
        self.slots[slot] = e
        if 2 * e > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = array("q", [-1]) * (self.mask + 1)
            for k, x in enumerate(self.digests):
                i = int.from_bytes(x[-8:], "little") & self.mask
                while self.slots[i] >= 0:
                    i = (i + 1) & self.mask
                self.slots[i] = k
        return e

    def add(self, e: int, i: int, own: int, holder: int, n: int, member: bool) -> None:
        self.counts[e] += n
        if (-i, own, holder) < (-self.best[e][0], *self.best[e][1:]):
            self.best[e] = (i, own, holder)
        if member:
            self.entries.append(e)
            self.holders.append(holder)
            self.bytes += MEMBER_BYTES


def grace(records: Iterable[tuple[bytes, int, int, int, int, bytes]], emit: Callable, budget: int = TABLE_BYTES, members: bool = False, level: int = 0) -> Iterator:
    """Groups (digest, id, raw hash, holder, rows, content) by content; yields what ``emit(table)`` yields, each content in exactly one table.

    With ``members`` a table knows which holder each record of a content came from, too. A full table still takes the
    holders of contents it has: ``MEMBER_BYTES`` for each of them.
    """
    held, files = OpenTable(), {}
    for digest, i, own, holder, n, content in records:
        if (e := held.find(digest, content)) < 0:
            if held.bytes > budget and held.digests:
                part = (int.from_bytes(digest[:8], "little") >> (FAN_OUT_BITS * level)) & ((1 << FAN_OUT_BITS) - 1)
                if part not in files:
                    files[part] = tempfile.TemporaryFile()
                files[part].write(struct.pack(_HEAD, digest, i, own, holder, n, len(content)))
                files[part].write(content)
                continue
            e = held.insert(~e, digest, content, (i, own, holder))
        held.add(e, i, own, holder, n, members)
    yield from emit(held)
    del held
    for f in files.values():
        f.seek(0)
        yield from grace(_spilled(f), emit, budget, members, level + 1 if level < 14 else 0)
        f.close()


def _spilled(f) -> Iterator[tuple[bytes, int, int, int, int, bytes]]:
    while head := f.read(struct.calcsize(_HEAD)):
        *record, size = struct.unpack(_HEAD, head)
        yield *record, f.read(size)


def _chunks(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes and rows; the last column may be a long binary."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += len(r[-1]) if isinstance(r[-1], bytes) else 0
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_MEMBERS = "part long, doc_id long, own long, sha binary"
_REPS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])
_CLASSES = pa.schema([("holder", pa.int64()), ("class_sha", pa.binary()), ("keep_id", pa.int64()), ("keep_own", pa.int64()), ("keep_part", pa.int64()), ("group_size", pa.int64())])


def _content(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes().lower() if text.is_valid else b""


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for b in batches:
        sha = [hashlib.sha256(_content(t)).digest() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int64()), b.column(0), b.column(1), pa.array(sha, pa.binary())], names=["part", "doc_id", "own", "sha"])


def _local(budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1).compress

        def records():
            for b in batches:
                for i, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    content = _content(text)
                    yield hashlib.sha256(content).digest(), NO_ID if i is None else i, own, part, 1, content

        def emit(held: OpenTable):
            for digest, content, (i, own, _), n in zip(held.digests, held.contents, held.best, held.counts, strict=True):
                yield part, None if i == NO_ID else i, own, n, digest, pack(content)

        yield from _chunks(grace(records(), emit, budget), _REPS)

    return run


def _global(budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def records():
            for b in batches:
                for part, i, own, n, sha, z in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5), strict=True):
                    yield sha, NO_ID if i is None else i, own, part, n, unpack(z.as_buffer())

        def emit(held: OpenTable):
            for e, holder in zip(held.entries, held.holders, strict=True):
                i, own, first = held.best[e]
                yield holder, held.digests[e], None if i == NO_ID else i, own, first, held.counts[e]

        yield from _chunks(grace(records(), emit, budget, members=True), _CLASSES)

    return run


def _decided(docs: DataFrame, table_bytes: int) -> DataFrame:
    """A row for each doc_id, raw text and input partition (``n`` rows of it): sha, its group's size, and whether one of its rows stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("own"), "text")
    reps = rows.mapInArrow(tidy(_local(table_bytes)), "part long, doc_id long, own long, n long, sha binary, content binary").repartition("sha")
    classes = reps.mapInArrow(tidy(_global(table_bytes)), "holder long, class_sha binary, keep_id long, keep_own long, keep_part long, group_size long")
    members = rows.mapInArrow(tidy(_members), _MEMBERS).repartition("part", "sha").groupBy("part", "sha", "doc_id", "own").agg(F.count("*").alias("n"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own"))
    return members.join(classes, (F.col("part") == F.col("holder")) & (F.col("sha") == F.col("class_sha"))).select("doc_id", "own", "sha", "n", "keep_id", "group_size", best.alias("best"), (best & (F.col("part") == F.col("keep_part"))).alias("kept"))


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest doc_id is kept, of repeated rows with that id exactly one. A null doc_id counts below every number, so
    keep_id is null only if all ids of the group are. An empty table gives an empty result. Columns of any other name
    are not read. A text larger than ``table_bytes`` is held alone.
    """
    rows = _decided(docs, table_bytes).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns, whatever their names; of rows repeated
    with one doc_id and text one stays. What goes is looked up by doc_id and text, so whole rows are shuffled only if too
    much goes to be broadcast."""
    decided = cut(_decided(docs, table_bytes).where("not best or n > 1 or not kept").select("doc_id", "own", "best", "n"))
    kept = without_rows(docs, decided.where("not best").select("doc_id", "own").distinct())
    again = decided.where("best").select("doc_id", "own").distinct()
    if again.isEmpty():
        return kept
    i, h, gi, gh = fresh(docs, "id", "own", "gone_id", "gone_own")
    keyed = kept.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    repeated = again.select(F.col("doc_id").alias(gi), F.col("own").alias(gh))
    same = F.col(i).eqNullSafe(F.col(gi)) & (F.col(h) == F.col(gh))
    return keyed.join(repeated, same, "left_anti").union(keyed.join(repeated, same, "left_semi").dropDuplicates([i, h])).drop(i, h)
