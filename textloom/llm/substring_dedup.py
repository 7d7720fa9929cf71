"""Substring dedup by relative Lempel-Ziv parsing.

Documents are dealt into parts. A part finds its own repeats and asks which of its anchors other parts hold: of each
window of words one word sequence about half as long, the one with the least hash, is the anchor, so equal windows have
equal anchors. Only the text around shared anchors goes on, to the reference block of its anchor. A block indexes all
text that came to it and parses each document's piece greedily against the documents with smaller ids: a factor is as
long as its words go on at one place of the reference, and at its end the next place is looked up again. The index
compares words, never hashes; hashes only decide what meets where. Factors are at least one window long, and their words
are duplicate. Anchors that very many windows share are dealt by window instead, so no block holds all of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts as P

WINDOW = 13
#: Bits of the anchors' hashes; fewer make more candidates, never other results.
SEED_BITS = 64
#: Anchors that so many parts hold, or so many windows of one part, are dealt by window. It changes no result.
HOT_PARTS, HOT_WINDOWS = 512, 512
#: A document without an id comes after all others.
NO_ID = (1 << 63) - 1


class Part(P.Words):
    """The documents of a part, by id, as one text, and the anchor of each window that lies inside a document."""

    def __init__(self, t: pa.Table, window: int, buckets: int, seed_bits: int) -> None:
        ids = t.column("doc_id").combine_chunks()
        texts = [b" ".join(x.as_buffer().to_pybytes().split()) if x.is_valid else b"" for x in t.column("text")]
        known = ids.is_valid().to_pylist()
        rows = sorted(zip((x if ok else NO_ID for x, ok in zip(ids.to_pylist(), known, strict=True)), known, texts, strict=True), key=lambda r: (r[0], r[2]))
        super().__init__([x for _, _, x in rows])
        self.window, self.rows = window, [(i if ok else None) for i, ok, _ in rows]
        n = max(0, len(self.head) - window + 1)
        self.doc = doc = np.repeat(np.arange(len(rows)), self.sizes)
        self.ids = np.array([i for i, _, _ in rows], np.int64)[doc]
        self.starts = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n else np.zeros(0, np.int64)
        short = (window + 1) // 2
        seeds = self.hashes(np.arange(n + window - short if n else 0), short)
        least, at = seeds[:n].copy(), np.arange(n)
        for k in range(1, window - short + 1):
            less = seeds[k : k + n] < least
            np.copyto(least, seeds[k : k + n], where=less)
            np.copyto(at, np.arange(k, k + n), where=less)
        self.anchor = at[self.starts]
        key = P.bucketed((least[self.starts] >> np.uint64(64 - seed_bits)) << np.uint64(64 - seed_bits), buckets)
        self.keys, self.key = np.unique(key, return_inverse=True)

    def shared(self) -> np.ndarray:
        """Which keys documents with different ids hold."""
        own = self.ids[self.starts]
        most, least = np.full(len(self.keys), -NO_ID - 1), np.full(len(self.keys), NO_ID)
        np.maximum.at(most, self.key, own)
        np.minimum.at(least, self.key, own)
        return most > least

    def hot(self, limit: int) -> np.ndarray:
        return np.bincount(self.key, minlength=len(self.keys)) > limit

    def first(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, the part's first window with the same words) as places, for the windows of these keys."""
        at = self.starts[which[self.key]]
        seen: dict[bytes, int] = {}
        return at, np.fromiter(map(seen.setdefault, self.spans(at, self.window), at.tolist()), np.int64, len(at))


_PIECES = "bucket long, part long, at binary, n binary, ids binary, own binary, words binary"
_PIECES_SCHEMA = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("at", "n", "ids", "own", "words"))])
_FACTORS = "part long, at binary, n binary, ids binary, own binary"
_FACTORS_SCHEMA = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("at", "n", "ids", "own"))])


def _questions(window: int, buckets: int, seed_bits: int, hot_windows: int) -> Callable:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        part = Part(t, window, buckets, seed_bits)
        return P.asked(key[0].as_py(), part.keys, part.hot(hot_windows))

    return run


def _pieces(window: int, buckets: int, seed_bits: int) -> Callable:
    """The text around anchors that other parts hold too, by block; each window that a part holds twice is sent once."""

    def run(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=3).compress
        if not t.num_rows or not told.num_rows:
            return P.table_of([], _PIECES_SCHEMA)
        part = Part(t, window, buckets, seed_bits)
        more, hot = P.answers(part.keys, told)
        at, first = part.first(more)
        at = at[at == first]
        if not len(at):
            return P.table_of([], _PIECES_SCHEMA)
        window_of = np.searchsorted(part.starts, at)
        own, anchor = part.key[window_of], part.anchor[window_of]
        loose = hot[own]
        new = np.concatenate([[True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | loose[1:]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(at)]]))
        at, loose = at[start], loose[start]
        block = P.bucket_of(part.keys[own[start]])
        if loose.any():
            block[loose] = P.bucket_of(P.bucketed(part.hashes(at[loose], window), buckets))
        by, rows = np.argsort(block, kind="stable"), []
        at, size, block = at[by], size[by], block[by]
        ids, doc_at = part.ids[at], at - part.cuts[part.doc[at]]
        for s, e in P.stretches(block):
            text = pack(b" ".join(part.spans(at[s:e], size[s:e] + window - 1)))
            rows.append((int(block[s]), key[0].as_py(), at[s:e].astype(np.int32).tobytes(), size[s:e].astype(np.uint16).tobytes(), ids[s:e].tobytes(), doc_at[s:e].astype(np.int32).tobytes(), text))
        return P.table_of(rows, _PIECES_SCHEMA)

    return run


def _block(window: int) -> Callable:
    """One reference block: indexes the words of all its windows with the smallest document that has them, and parses every piece."""

    def run(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        index: dict[bytes, int] = {}
        columns: list[tuple] = []
        for k, (at, n, ids, own, text) in enumerate(zip(*(t.column(c).to_pylist() for c in ("at", "n", "ids", "own", "words")), strict=True)):
            n, text = np.frombuffer(n, np.uint16).astype(np.int64), unpack(text)
            space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            head, tail = np.concatenate([[0], space + 1]), np.concatenate([space, [len(text)]])
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.repeat(np.cumsum(n + window - 1) - (n + window - 1), n) + step
            code = np.fromiter((index.setdefault(text[a:b], len(index)) for a, b in zip(head[first].tolist(), tail[first + window - 1].tolist(), strict=True)), np.int64, len(first))
            columns.append((code, np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(own, np.int32), n) + step, np.full(len(first), k), np.repeat(np.frombuffer(at, np.int32), n) + step, step == 0))
        code, ids, own, row, at, edge = (np.concatenate(x) for x in zip(*columns, strict=True))
        by = np.lexsort((own, ids, code))
        least = by[np.flatnonzero(np.concatenate([[True], np.diff(code[by]) != 0]))]
        doc, place = ids[least][code], own[least][code]
        known = doc < ids
        # A factor goes on while its piece and the reference do.
        goes_on = np.concatenate([[False], known[1:] & known[:-1] & ~edge[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)])
        start = np.flatnonzero(known & ~goes_on)
        size = np.add.reduceat(known, start, dtype=np.int64) if len(start) else start
        part = np.asarray(t.column("part"))[row[start]]
        by, out = np.argsort(part, kind="stable"), []
        part = part[by]
        for s, e in P.stretches(part):
            f = start[by[s:e]]
            out.append((int(part[s]), at[f].astype(np.int32).tobytes(), size[by[s:e]].astype(np.uint16).tobytes(), doc[f].tobytes(), place[f].astype(np.int32).tobytes()))
        return P.table_of(out, _FACTORS_SCHEMA)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:bigint,words:bigint,ref_doc:bigint,ref_start:bigint>>"
_OUT_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_FACTOR = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "ref_doc", "ref_start")]))
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("factors", _FACTOR)])


def _parsed(window: int, buckets: int, seed_bits: int, digest_only: bool) -> Callable:
    """Every document of a part with the factors that its part and the blocks found."""
    schema = pa.schema(list(_OUT_SCHEMA)[: 4 if digest_only else 6])

    def run(t: pa.Table, factors: pa.Table) -> pa.Table:
        if not t.num_rows:
            return P.table_of([], schema)
        part = Part(t, window, buckets, seed_bits)
        n = len(part.head)
        ref_doc, ref_at = np.full(n, NO_ID), np.zeros(n, np.int64)
        told = np.zeros(n, bool)
        for at, size, ids, own in zip(*(factors.column(c).to_pylist() for c in ("at", "n", "ids", "own")), strict=True):
            size = np.frombuffer(size, np.uint16).astype(np.int64)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            where = np.repeat(np.frombuffer(at, np.int32).astype(np.int64), size) + step
            told[where] = True
            ref_doc[where], ref_at[where] = np.repeat(np.frombuffer(ids, np.int64), size), np.repeat(np.frombuffer(own, np.int32), size) + step
        which = part.shared()
        which[part.key[told[part.starts]]] = True
        at, first = part.first(which)
        near, far = part.ids[first] < part.ids[at], told[first]
        known = near | far
        at, first, far = at[known], first[known], far[known]
        doc = np.where(far, ref_doc[first], part.ids[first])
        place = np.where(far, ref_at[first], first - part.cuts[part.doc[first]])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, np.minimum(at + window, n), 1)
        gone = np.cumsum(edge[:-1]) > 0
        cuts, rows = part.cuts.tolist(), []
        bytes_at = np.concatenate([part.head, [len(part.flat) + 1]]).tolist()
        if not digest_only:
            new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(place) != 1)])) if len(at) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([new, [len(at)]])) + window - 1
            owner = part.doc[at[new]] if len(new) else new
        for k, (i, s, e) in enumerate(zip(part.rows, cuts, cuts[1:], strict=False)):
            kept, removed = part.flat[bytes_at[s] : bytes_at[e] - 1] if e > s else b"", int(gone[s:e].sum())
            if removed:
                kept = b" ".join(w for w, x in zip(kept.split(b" "), gone[s:e].tolist(), strict=True) if not x)
            row = (i, e - s, removed, hashlib.sha256(kept).hexdigest())
            if not digest_only:
                a, b = np.searchsorted(owner, [k, k + 1]).tolist()
                row += (kept.decode(), [{"start": int(at[f]) - s, "words": int(x), "ref_doc": int(doc[f]), "ref_start": int(place[f])} for f, x in zip(new[a:b], size[a:b], strict=True)])
            rows.append(row)
        return P.table_of(rows, schema)

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW, digest_only: bool = False, seed_bits: int = SEED_BITS, part_bytes: int = P.PART_BYTES, hot_parts: int = HOT_PARTS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, unless ``digest_only``, kept_text and factors.

    Words are separated by ASCII white space. A window of ``window`` words is duplicate if the same words also start in a
    document with a smaller doc_id, judged on the input; every word of a duplicate window is removed. A factor says which
    words it covers (start, words) and where a smaller document has them (ref_doc, ref_start); factors overlap where a
    window across the end of one is duplicate too. Null and empty texts have no words; a null doc_id comes after every
    number. Rows with equal doc_id never make each other duplicate. Repeated rows are repeated in the result; an empty
    table gives an empty result. Other columns than doc_id and text are not read, whatever their names. A text that is
    larger than a part is a part by itself. The words of a document are at most 2^31.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = P.part_count(rows, part_bytes)
    dealt = P.dealt(rows, n).groupBy("part")
    told = P.told_by_buckets(dealt.applyInArrow(_questions(window, n, seed_bits, hot_windows), P.ASKED), hot_parts)
    pieces = dealt.cogroup(told.groupBy("part")).applyInArrow(_pieces(window, n, seed_bits), _PIECES)
    factors = pieces.groupBy("bucket").applyInArrow(_block(window), _FACTORS)
    return dealt.cogroup(factors.groupBy("part")).applyInArrow(_parsed(window, n, seed_bits, digest_only), _OUT_DIGEST if digest_only else _OUT)
