"""Documents dealt into parts of bounded size, and the exchange that tells a part which of its keys other parts hold.

A part meets its documents in one task, as often as a method needs them; the shuffle that deals them is used again. What
parts ask each other is packed, a row for each part and bucket of keys, so no key is ever a row and a hot key costs a
part as much as a rare one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

#: Text of a part. Parts and buckets grow in number with the input, not in size.
PART_BYTES = 2 << 20
#: Bytes of a key that travel, besides its bucket. Keys that agree in these are taken for one, so a key that is shared is only a candidate.
KEY_BYTES = 5
_LOW = np.uint64((1 << (8 * KEY_BYTES)) - 1)
_SHIFT = np.uint64(8 * KEY_BYTES)


#: An odd number and its inverse modulo 2^64: hashes of any stretch of bytes follow from the sums before its two ends.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64; short tables are kept."""
    if (have := _powers.get(base)) is None or len(have) < n:
        have = np.full(max(n, 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * PART_BYTES:
            _powers[base] = have
    return have[:n]


class Words:
    """Texts whose words have one space between, as one such text; ``cuts`` are the texts' first words."""

    def __init__(self, texts: list[bytes]) -> None:
        pa.default_memory_pool().release_unused()  # what the part before this one left
        self.sizes = np.array([x.count(b" ") + 1 if x else 0 for x in texts], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = b" ".join(x for x in texts if x)
        data, some = np.frombuffer(self.flat, np.uint8), int(bool(self.flat))
        space = np.flatnonzero(data == 32)
        #: First and last byte of each word, the last one excluded.
        self.head, self.tail = np.concatenate([np.zeros(some, np.int64), space + 1]), np.concatenate([space, np.full(some, len(data))])
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Of ``size`` words from each of these places."""
        start = self.head[at]
        x = (self.sums[self.tail[at + size - 1]] - self.sums[start]) * powers(_INVERSE, len(self.flat))[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))

    def spans(self, at: np.ndarray, size: int | np.ndarray) -> list[bytes]:
        """The text of ``size`` words from each of these places."""
        flat = self.flat
        return [flat[a:b] for a, b in zip(self.head[at].tolist(), self.tail[at + size - 1].tolist(), strict=True)]


def part_count(rows: DataFrame, part_bytes: int = PART_BYTES) -> int:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(1 << 24, max(2 * partitions(rows.sparkSession), -(-size // part_bytes)))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with their part. Equal rows of one input partition share a part, those of different ones need not."""
    return rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(parts)))


def bucketed(x: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit hashes as numbers whose upper bits are the bucket and whose lower ones are what travels."""
    return ((((x >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)) << _SHIFT) | (x & _LOW)


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key >> _SHIFT).astype(np.int64)


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each stretch of equal values."""
    if not len(x):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


ASKED = "bucket long, part long, keys binary, hot binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary())])
TOLD = "part long, bucket long, more binary, hot binary"
_TOLD = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("more", pa.binary()), ("hot", pa.binary())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)


def asked(part: int, keys: np.ndarray, hot: np.ndarray) -> pa.Table:
    """A part's sorted distinct keys, a row for each bucket; hot: keys whose holders must not meet by key alone."""
    return table_of([(int(bucket_of(keys[s : s + 1])[0]), part, packed(keys[s:e]), np.packbits(hot[s:e]).tobytes() if hot[s:e].any() else b"") for s, e in stretches(bucket_of(keys))], _ASKED)


def _bits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) if x else np.zeros(n, bool)


def told_by_buckets(questions: DataFrame, hot_parts: int) -> DataFrame:
    """Which keys of each question two parts or more hold, and which are hot, in some part or because over ``hot_parts`` hold them."""

    def bucket(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("part", "bucket", "keys", "hot")), strict=True))
        keys = [unpacked(r[2]) for r in rows]
        sizes = [len(x) for x in keys]
        flat, hot = np.concatenate(keys), np.concatenate([_bits(r[3], n) for r, n in zip(rows, sizes, strict=True)])
        _, run, count = np.unique(flat, return_inverse=True, return_counts=True)
        warm = np.zeros(len(count), bool)
        warm[run[hot]] = True
        more, hot = (count > 1)[run], (warm | (count > hot_parts))[run]
        out, at = [], 0
        for r, n in zip(rows, sizes, strict=True):
            if more[at : at + n].any():
                own = hot[at : at + n] & more[at : at + n]
                out.append((r[0], r[1], np.packbits(more[at : at + n]).tobytes(), np.packbits(own).tobytes() if own.any() else b""))
            at += n
        return table_of(out, _TOLD)

    return questions.groupBy("bucket").applyInArrow(bucket, TOLD)


def answers(keys: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(held by other parts too, hot) for the sorted distinct keys that were asked."""
    more, hot, at = np.zeros(len(keys), bool), np.zeros(len(keys), bool), bucket_of(keys)
    for bucket, m, h in zip(*(told.column(c).to_pylist() for c in ("bucket", "more", "hot")), strict=True):
        s, e = np.searchsorted(at, [bucket, bucket + 1]).tolist()
        more[s:e], hot[s:e] = _bits(m, e - s), _bits(h, e - s)
    return more, hot
