"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are the benchmark's windows of words. A shift table over hashed blocks says how far a position can move
without missing a pattern; where the shift is zero, the bucket of that block lists the patterns to compare directly.
Many start positions of a batch advance together, so the inner loop is vectorised.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, scratch, tidy

WINDOW = 13
SHARD_BYTES, SHARDS_AT_ONCE = 4 << 20, 4
BATCH_BYTES = 8 << 20
LANE = 2048
#: Bytes that split words become spaces, A-Z become a-z, bytes from 0x80 are part of words.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TABLE_BITS = 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def item_windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Each window of an item as a pattern with a space on either side; a shorter item, if not empty, is one window."""
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(n)]


class WuManber:
    """Patterns of one length class, by the ``m`` bytes all of them have at least."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns, self.m = patterns, min(map(len, patterns))
        self.block = min(16, self.m, max(2, self.m // 2))
        prefixes = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        last = self.m - self.block
        self.shift = np.full(1 << TABLE_BITS, last + 1, np.int32)
        for j in range(last + 1):
            np.minimum.at(self.shift, self._hash(prefixes.reshape(-1), np.arange(len(patterns)) * self.m + j), last - j)
        self.buckets: dict[int, list[int]] = {}
        for k, h in enumerate(self._hash(prefixes.reshape(-1), np.arange(len(patterns)) * self.m + last).tolist()):
            self.buckets.setdefault(h, []).append(k)

    @classmethod
    def of(cls, state: dict) -> WuManber:
        """An index from its parts, which travel as plain values."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def _hash(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = min(8, self.block)
        step = np.arange(w)
        a = np.zeros((len(at), 8), np.uint8)
        a[:, :w] = data[at[:, None] + step]
        x = a.view(np.uint64).ravel() * _K1
        if self.block > 8:
            a[:, :w] = data[(at + self.block - w)[:, None] + step]
            x ^= (a.view(np.uint64).ravel() * _K2) >> np.uint64(7)
            x *= _K1
        return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(position, pattern) of every occurrence."""
        buf, n = np.frombuffer(data, np.uint8), len(data) - self.m + 1
        if n <= 0:
            return
        at = np.arange(0, n, LANE)
        end = np.minimum(at + LANE, n)
        last = self.m - self.block
        while len(at):
            h = self._hash(buf, at + last)
            s = self.shift[h]
            for p, x in zip(at[zero := s == 0].tolist(), h[zero].tolist(), strict=True):
                for k in self.buckets.get(x, ()):
                    if data.startswith(self.patterns[k], p):
                        yield p, k
            at = at + np.maximum(s, 1)
            if not (live := at < end).all():
                at, end = at[live], end[live]


def build(items: list[tuple[str, bytes]], size: int = WINDOW) -> list[tuple[WuManber, list[int], list[list[str]]]]:
    """An index for each class of pattern lengths, with the words and the items of each pattern."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for p in item_windows(words_of(text), size):
            owners[p].add(item)
    classes: dict[int, list[bytes]] = defaultdict(list)
    for p in sorted(owners):
        classes[min(6, len(p).bit_length())].append(p)
    return [(WuManber(ps), [p.count(b" ") - 1 for p in ps], [sorted(owners[p]) for p in ps]) for ps in classes.values()]


def _scan(index, mode: str, spans: str, items: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(WuManber.of(state), n_words, owners) for state, n_words, owners in index.value]
        for b in batches:
            at = 0
            while at < b.num_rows:  # by bytes, so that very long texts do not pile up
                end, size = at, 0
                while end < b.num_rows and (end == at or size < BATCH_BYTES):
                    size += len(t.as_buffer()) if (t := b.column("text")[end]).is_valid else 0
                    end += 1
                yield scan_batch(machines, b.slice(at, end - at), mode, spans, items)
                at = end

    return run


def scan_batch(index, b: pa.RecordBatch, mode: str, spans_in: str, items_in: str) -> pa.RecordBatch:
    """Adds one index's hits to those in the columns ``spans_in`` and ``items_in``; carries them on, or ends with a digest or a filter."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text")]
    docs = [b" ".join(words_of(t)) for t in texts]
    data = b"\n".join(b" " + d + b" " for d in docs)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    sizes = np.array([d.count(b" ") + 1 if d else 0 for d in docs], np.int64)
    slots = np.where(sizes == 0, 2, sizes + 1)  # spaces of each document
    first = np.concatenate([[0], np.cumsum(slots)])
    items: list[set[str]] = [set(x or ()) for x in b.column(items_in).to_pylist()]
    hit = np.zeros(len(space) + 1, np.int64)
    for d, spans in enumerate(b.column(spans_in).to_pylist()):
        for s, e in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
            hit[first[d] + s] += 1
            hit[first[d] + e] -= 1
    for wm, n_words, owners in index:
        if found := list(wm.search(data)):
            at = np.searchsorted(space, np.array([p for p, _ in found]))
            which = np.searchsorted(first, at, "right") - 1
            n = np.array([n_words[k] for _, k in found])
            np.add.at(hit, at, 1)
            np.subtract.at(hit, at + n, 1)
            for d, k in set(zip(which.tolist(), (k for _, k in found), strict=True)):
                items[d].update(owners[k])
    inside = np.cumsum(hit) > 0
    if mode == "carry":
        spans = [np.flatnonzero(np.diff(np.concatenate([[0], inside[first[d] : first[d] + sizes[d]].astype(np.int8), [0]]))).tolist() for d in range(len(docs))]
        new = {spans_in: pa.array(spans, pa.list_(pa.int64())), items_in: pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        return pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)
    total = np.concatenate([[0], np.cumsum(inside)])
    n_hit = total[first[:-1] + sizes] - total[first[:-1]]
    contaminated = [h > 0 and 20 * h >= n for h, n in zip(n_hit.tolist(), sizes.tolist(), strict=True)]
    if mode == "filter":
        return b.drop_columns([spans_in, items_in]).filter(pa.array([not x for x in contaminated], pa.bool_()))
    cols = [
        b.column("doc_id"), pa.array(sizes), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
        pa.array(contaminated, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _index(spark: SparkSession, items: DataFrame, k: int, shards: int, window: int):
    """The index of one shard of the benchmark, sent out."""
    part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
    return spark.sparkContext.broadcast([(vars(wm), n_words, owners) for wm, n_words, owners in build([(r.item, r.text.encode()) for r in part.collect()], window)])


def _hits(spark: SparkSession, docs: DataFrame, items: DataFrame, shards: int, window: int, names: list[str]) -> DataFrame:
    """(doc_id, hash of the text, spans, items) of the documents that any of many shards hits, without their texts. Each few
    shards are one pass over ``docs``, after which their hits are written down and their indexes go."""
    i, h, spans, found = names
    rows = docs.select(F.col("doc_id").cast("long").alias(i), F.xxhash64(F.col("text").cast("string")).alias(h), F.col("text").cast("string").alias("text"), F.array().cast("array<bigint>").alias(spans), F.array().cast("array<string>").alias(found))
    parts = []
    for start in range(0, shards, SHARDS_AT_ONCE):
        indexes = [_index(spark, items, k, shards, window) for k in range(start, min(shards, start + SHARDS_AT_ONCE))]
        df = rows
        for index in indexes:
            df = df.mapInArrow(tidy(_scan(index, "carry", spans, found)), rows.schema)
        parts.append(scratch(df.where(F.size(spans) > 0).drop("text").dropDuplicates([i, h]), "hits"))
        for index in indexes:
            index.destroy()
    return reduce(DataFrame.union, parts).groupBy(i, h).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(found))).alias(found))


def _passed(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, mode: str, schema) -> DataFrame:
    """``docs`` past all shards of the benchmark's index. Its size is measured first; the patterns go out in as many
    broadcasts of at most about ``shard_bytes`` of text as it takes. The documents pass up to SHARDS_AT_ONCE in one
    stage; of a larger benchmark the hits alone are written down and joined to the documents in the end, so no executor holds
    all of it and no text is written."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    i, h, spans, found = fresh(docs, "id", "own", "spans", "items")
    none = {spans: F.array().cast("array<bigint>"), found: F.array().cast("array<string>")}
    if shards <= SHARDS_AT_ONCE:
        df = docs.withColumns(none)
        for k in range(shards):
            last = k == shards - 1
            df = df.mapInArrow(tidy(_scan(_index(spark, items, k, shards, window), mode if last else "carry", spans, found)), schema if last else df.schema)
        return df
    hits = _hits(spark, docs, items, shards, window, [i, h, spans, found])
    gi, gh = fresh(docs, "hit_id", "hit_own")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    both = keyed.join(hits.withColumnsRenamed({i: gi, h: gh}), F.col(i).eqNullSafe(F.col(gi)) & (F.col(h) == F.col(gh)), "left")
    both = both.select(*docs.columns, *(F.coalesce(F.col(c), v).alias(c) for c, v in none.items()))
    return both.mapInArrow(tidy(_scan(spark.sparkContext.broadcast([]), mode, spans, found)), schema)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hits of at least a twentieth of the words).

    An item with null text has no window; a null item_id counts as the id "". A document with null or empty text has
    zero words and no hits. Without items nothing is hit. Repeated rows are repeated, repeated items count once; an
    empty table stays empty. Other columns than doc_id and text are not read. A text longer than ``BATCH_BYTES`` is a
    batch by itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _passed(spark, rows, benchmark, window, shard_bytes, "digest", DIGEST)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` that :func:`contamination` does not call contaminated, with all their columns, whatever their names."""
    return _passed(spark, docs, benchmark, window, shard_bytes, "filter", docs.schema)

