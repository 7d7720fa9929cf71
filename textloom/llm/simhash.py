"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most ``bits`` bits, then from some
segment on every chain of l consecutive segments differs in at most floor(l * bits / segments) bits. The first links
of such a chain have no budget at all, so their bits, with the start, are an exact key; where the budget then stays at
one for two more segments, one of those two is equal as well and joins the key. Inside a key, chains are checked link
by link before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .near_copies import near_copy_rows
from .shared import cut, tidy, without_rows

BITS, SEGMENTS, SHINGLE, SEED = 2, 5, 3, 42
LONG_RUN = 256
_CHUNK = 200_000


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is one if it is set in over half of the shingles' XXH64; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    digest, held, owners, n_held = xxhash.xxh64_intdigest, [], [], 0

    def flush() -> None:
        nonlocal held, owners, n_held
        if held:
            sizes = np.array([len(x) for x in held])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bits = np.unpackbits(np.concatenate(held).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            np.add.at(total, owners, ones)
        held, owners, n_held = [], [], 0

    total = np.zeros((len(texts), 64), np.int64)
    count = np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        k = min(shingle, len(words))
        starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
        count[d] = len(hashes)
        for at in range(0, len(hashes), _CHUNK):
            held.append(hashes[at : at + _CHUNK])
            owners.append(d)
            n_held += len(held[-1])
            if n_held >= _CHUNK:
                flush()
    flush()
    ones = (2 * total > count[:, None]).astype(np.uint8)
    out[:] = np.packbits(ones, axis=1).view(">u8").ravel()
    return out


def _fingerprint(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fingerprints_of([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)], shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


class Ring:
    """Segments of the fingerprint, from the lowest bits on, and the budget of each chain length."""

    def __init__(self, bits: int = BITS, segments: int = SEGMENTS) -> None:
        if not 0 <= bits < segments <= 64:
            raise ValueError("there must be more segments than bits that may differ")
        self.bits, self.segments = bits, segments
        cuts = [64 * k // segments for k in range(segments + 1)]
        self.at = list(zip(cuts, cuts[1:], strict=False))
        self.masks = [(((1 << (b - a)) - 1) << a) for a, b in self.at]
        self.budget = [length * bits // segments for length in range(segments + 1)]
        self.free = max(length for length in range(1, segments + 1) if self.budget[length] == 0)
        refine = self.free + 2 <= segments and self.budget[self.free + 2] == 1
        #: (start, segments that are equal)
        self.keys = [(i, [(i + j) % segments for j in range(self.free)] + extra) for i in range(segments) for extra in ([[(i + self.free) % segments], [(i + self.free + 1) % segments]] if refine else [[]])]

    def columns(self, fp: Column) -> Column:
        """An array of (which key, the equal bits)."""
        mask = [sum(self.masks[s] for s in equal) for _, equal in self.keys]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return F.array(*(F.struct(F.lit(k).alias("key"), fp.bitwiseAND(F.lit(signed(m))).alias("equal")) for k, m in enumerate(mask)))

    def viable(self, x: np.ndarray, start: int) -> np.ndarray:
        """Which differences x pass every chain from ``start``, and the full distance."""
        ok, sums = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for length in range(1, self.segments + 1):
            sums += np.bitwise_count(x & np.uint64(self.masks[(start + length - 1) % self.segments]))
            ok &= sums <= self.budget[length]
        return ok & (sums <= self.bits)

    def neighbours(self, equal: list[int]) -> np.ndarray:
        """All differences of 1 to ``bits`` bits outside the equal segments."""
        loose = [np.uint64(1) << np.uint64(b) for s, (lo, hi) in enumerate(self.at) if s not in equal for b in range(lo, hi)]
        out, level = [], [(np.uint64(0), -1)]
        for _ in range(self.bits):
            level = [(m | loose[j], j) for m, i in level for j in range(i + 1, len(loose))]
            out += [m for m, _ in level]
        return np.array(out, np.uint64)


def _links(ring: Ring) -> Callable:
    """Links within runs of equal keys; a run's links are a forest with the run's components."""

    def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := top(x)) != (q := top(y)):
                up[max(p, q)] = min(p, q)
        pairs = [(x, r) for x in up if (r := top(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]

    def of(key: np.ndarray, equal: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (equal[1:] != equal[:-1])]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        run = np.repeat(np.arange(len(start)), size)
        short = size[run] <= LONG_RUN
        left, right = [], []
        for step in range(1, int(min(LONG_RUN, size.max(initial=1)))):
            at = np.flatnonzero((run[step:] == run[:-step]) & short[:-step])
            if not len(at):
                break
            x = fp[at] ^ fp[at + step]
            for k in np.unique(key[at]):
                own = key[at] == k
                good = at[own][ring.viable(x[own], ring.keys[k][0])]
                left.append(fp[good])
                right.append(fp[good + step])
        for r in np.flatnonzero(size > LONG_RUN):
            whole = fp[start[r] : start[r] + size[r]]  # sorted: looking up all neighbours is linear in the run
            for m in ring.neighbours(ring.keys[key[start[r]]][1]):
                other = whole ^ m
                at = np.searchsorted(whole, other)
                found = (at < len(whole)) & (whole[np.minimum(at, len(whole) - 1)] == other) & (whole < other)
                left.append(whole[found])
                right.append(other[found])
        if left:
            a, b = forest(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)).view(np.uint64)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])  # the last run may go on
            if held and same.all() and (held[-1][0][-1], held[-1][1][-1]) == (now[0][0], now[1][0]):
                held.append(now)
                continue
            cut_at = b.num_rows - int(same.sum())
            if held or cut_at:
                held.append([x[:cut_at] for x in now])
                yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [[x[cut_at:] for x in now]]
        if held:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_fingerprint(shingle)), "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` with at most ``bits`` differing bits."""
    ring = Ring(bits, segments)
    keyed = fps.select("fp", F.explode(ring.columns(F.col("fp"))).alias("k")).select(F.col("k.key").alias("key"), F.col("k.equal").alias("equal"), "fp")
    # Long runs look values up by their order as unsigned numbers.
    keyed = keyed.repartition("key", "equal").sortWithinPartitions("key", "equal", F.col("fp") < 0, "fp")
    return keyed.mapInArrow(tidy(_links(ring)), "a long, b long").distinct()


def near_groups(docs: DataFrame, bits: int = BITS, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts have the fingerprint zero and link like any other; equal fingerprints are one node, so copies are never
    paired. Null ids do not name a component, which is null only if all its ids are. Repeated rows are repeated in the
    result. An empty table gives an empty result. Other columns are not read; long texts are hashed in slices, whole.
    """
    table = cut(fingerprint_table(docs, shingle))
    nodes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), bits, segments))
    named = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(whole, "root").select(F.col("fp").alias("of"), "component_id")
    return table.join(labels, table.fp == labels.of).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike_texts(docs: DataFrame, bits: int = BITS, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """(own, class): the texts of ``docs``, by xxhash64, and the least fingerprint that each reaches, as in :func:`near_groups`."""
    text = F.col("text").cast("string")
    table = cut(fingerprint_table(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), shingle).distinct())
    roots = connected_components(fingerprint_links(table.select("fp").distinct(), bits, segments))
    return table.join(roots, table.fp == roots.node, "left").select(F.col("doc_id").alias("own"), F.coalesce("root", "fp").alias("class"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group of near copies, with all their columns, whatever their names: one
    document of each group. Candidates are the texts that fingerprints link, and then all that share rare shingles, since
    fingerprints miss most copies of the stated similarity (five-word Jaccard 4/5), which decides on either. Rows without an
    id stay only if their whole group has none. What goes is looked up by doc_id and text."""
    gone = cut(near_copy_rows(docs, alike=alike_texts(docs)).where("not doc_id <=> component_id").select("doc_id", "own").distinct())
    return without_rows(docs, gone)
