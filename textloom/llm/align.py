"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokens of either side that share a byte are joined by an edge; the connected components of that graph, found by
union-find, are the minimal groups between byte offsets where tokens of both sides end. Each component links all its
tokens of one side with all of the other. How many documents hold a pair of ids linked is counted by Spark.

Neither side joins what comes before a single space with what comes after it, so a text is cut there, and the graph of
a text is that of its pieces side by side. Pieces repeat, so a task keeps what it knows of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import scratch, tidy

#: Pieces that a task remembers, and bytes of those it remembers one by one.
CACHE, PIECE = 200_000, 200
#: Bytes of text that are aligned at a time.
BATCH = 4 << 20
#: Pairs of ids whose counts are sent to tasks; more are joined instead.
PAIRS = 4_000_000
#: Links of a group from which its different pairs are counted instead of all of its pairs.
LARGE = 256
#: Fixed values of the first side's format: how its words are told apart, and the printable characters that stand for their own byte.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OWN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: A space between two characters that are none; what is before it and what is after it are tokenized apart.
_CUT = re.compile(r" (?<=\S )(?=\S)")


class ByteLevel:
    """The byte-level tokenizer of a JSON file. Where ids follow the order of its merges, the faster library encodes."""

    def __init__(self, data: bytes) -> None:
        held = json.loads(data)
        vocabulary, others = held["model"]["vocab"], [b for b in range(256) if b not in set(OWN_BYTES)]
        back = {chr(b): b for b in OWN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in held.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(back[c] for c in token)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        plain = held["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": held["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        self.slow = Tokenizer.from_buffer(data)
        self.slow.encode_special_tokens = True
        self.fast = None
        if plain and not held.get("normalizer") and merged == sorted(merged) and len(set(merged)) == len(merged) and min(merged, default=0) >= 256:
            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        if self.fast:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """The piece tokenizer of a model file, which puts a space before each text by itself."""

    def __init__(self, data: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes on behind a letter with a space.
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def components(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of ``size`` nodes under the edges (u, v): roots are hooked to the least
    root beside them and paths halved until no edge joins two roots."""
    root = np.arange(size)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the group of each token, from where tokens of either side end; both sides end at the same byte."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    first = np.arange(len(ends_a))
    root = components(len(ends_a) + len(ends_b), np.searchsorted(ends_a, ends), len(ends_a) + np.searchsorted(ends_b, ends))
    number = np.cumsum(root[: len(ends_a)] == first) - 1  # the smallest node of a group is its first token of the first side
    return number[root[: len(ends_a)]], number[root[len(ends_a) :]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


class Aligner:
    """Groups and links of texts. A pair of ids is one number, the first side's times the size of the second, plus the second's."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b, self.width = a, b, len(b.bytes)
        self.span = len(a.bytes) * self.width
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (a, b)]
        #: By id its decimal form before another of its side, and at the end of its side of a group.
        self.decimals = [[np.array([b"%d%s" % (i, mark) for i in range(len(side.bytes))], object) for mark in marks] for side, marks in ((a, (b",", b"|")), (b, (b",", b";")))]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[bytes] = []
        #: By piece: whether its bytes are those of the text, tokens of either side, groups, links, where its pairs begin and end.
        self.facts = np.zeros((0, 7), np.int64)
        self.pairs = self.times = np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces that are not known yet, all in one graph: no token of one piece reaches into the next."""
        want, ids, names = [b" " + p.encode() for p in pieces], [self.a.encode(pieces), self.b.encode(pieces)], [self.a.bytes, self.b.bytes]
        flat = [np.fromiter(chain.from_iterable(side), np.int64) for side in ids]
        size = [np.fromiter(map(len, side), np.int64, len(pieces)) for side in ids]
        right = np.ones(len(pieces), bool)
        for name, side, n in zip(names, flat, size, strict=True):
            got, cut = b"".join(map(name.__getitem__, side.tolist())), np.cumsum([0, *map(len, want)])
            ends = np.concatenate([[0], np.cumsum(self.lengths[side is flat[1]][side])])[np.cumsum(np.concatenate([[0], n]))]
            if got != b"".join(want) or not np.array_equal(ends, cut):
                right &= [got[x:y] == w for x, y, w in zip(ends[:-1], ends[1:], want, strict=True)]
        a, b = (side[np.repeat(right, n)] for side, n in zip(flat, size, strict=True))
        size = [n * right for n in size]
        ends = [np.cumsum(of[side]) for of, side in zip(self.lengths, (a, b), strict=True)]
        group_a, group_b = groups(*ends)
        n = int(group_a[-1]) + 1 if len(a) else 0
        cut_a, cut_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
        piece_of = np.repeat(np.arange(len(pieces)), size[0])[cut_a[:-1]]
        keys, times = _summed(*self._links(a, b, cut_a, cut_b, piece_of))
        known, cuts = len(self.texts), np.searchsorted(keys, np.arange(len(pieces) + 1) * self.span) + len(self.pairs)
        links = np.bincount(piece_of, np.diff(cut_a) * np.diff(cut_b), len(pieces)).astype(np.int64)
        facts = np.stack([right.astype(np.int64), *size, np.bincount(piece_of, minlength=len(pieces)), links, cuts[:-1], cuts[1:]], 1)
        self.facts, self.pairs, self.times = np.concatenate([self.facts, facts]), np.concatenate([self.pairs, keys % self.span]), np.concatenate([self.times, times])
        out = np.empty(len(a) + len(b), object)
        for side, cut, place, (inside, closing) in zip((a, b), (cut_a, cut_b), (np.arange(len(a)) + cut_b[group_a], np.arange(len(b)) + cut_a[group_b + 1]), self.decimals, strict=True):
            out[place] = inside[side]
            out[place[cut[1:] - 1]] = closing[side[cut[1:] - 1]]
        out, stop = out.tolist(), np.cumsum(np.concatenate([[0], size[0] + size[1]])).tolist()
        self.texts += [b"".join(out[x:y]) for x, y in zip(stop[:-1], stop[1:], strict=True)]
        self.at |= {piece: known + k for k, piece in enumerate(pieces)}

    def _links(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, piece_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids by piece, with their number; of large groups each different pair once."""
        size_a, size_b = np.diff(cut_a), np.diff(cut_b)
        small = np.flatnonzero(size_a * size_b <= LARGE)
        n = (size_a * size_b)[small]
        k, wide = _ranges(np.zeros(len(n), np.int64), n), np.repeat(size_b[small], n)
        x, y = a[np.repeat(cut_a[small], n) + k // wide], b[np.repeat(cut_b[small], n) + k % wide]
        keys, times = [np.repeat(piece_of[small], n) * self.span + x * self.width + y], [np.ones(len(k), np.int64)]
        for g in np.flatnonzero(size_a * size_b > LARGE):
            (x, nx), (y, ny) = (np.unique(side[cut[g] : cut[g + 1]], return_counts=True) for side, cut in ((a, cut_a), (b, cut_b)))
            keys.append(piece_of[g] * self.span + np.add.outer(x * self.width, y).ravel())
            times.append(np.multiply.outer(nx, ny).ravel())
        return np.concatenate(keys), np.concatenate(times)

    def __call__(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Counts, the digest of the groups, and the different pairs with their number, all texts' one after the other."""
        cut = _CUT.split if self.b.apart else (lambda t: [t])
        pieces = [cut(t) if t else [] for t in texts]
        if len(self.texts) > CACHE:
            self.clear()
        new = {p for ps in pieces for p in ps if p not in self.at}
        self.learn(list(new))
        used = [[self.at[p] for p in ps] for ps in pieces]
        for p in new:  # long pieces are not kept by name
            if len(p) > PIECE:
                del self.at[p]
        size = np.array([len(x) for x in used], np.int64)
        flat, of = np.fromiter(chain.from_iterable(used), np.int64), np.repeat(np.arange(len(texts)), size)
        sums = np.zeros((len(texts), 5), np.int64)
        np.add.at(sums, of, self.facts[flat, :5])
        right = (sums[:, 0] == size) & (size > 0)
        sums *= right[:, None]
        digests = [hashlib.sha256(b"".join([self.texts[i] for i in x])[:-1]).hexdigest() if ok else "" for x, ok in zip(used, right, strict=True)]
        kept = right[of]
        held, n = _summed(of[kept] * len(self.texts) + flat[kept], np.ones(kept.sum(), np.int64))
        doc, piece = held // max(1, len(self.texts)), held % max(1, len(self.texts))
        start, count = self.facts[piece, 5], self.facts[piece, 6] - self.facts[piece, 5]
        at = _ranges(start, count)
        keys, times = _summed(np.repeat(doc, count) * self.span + self.pairs[at], np.repeat(n, count) * self.times[at])
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) * self.span)
        return {"sums": sums[:, 1:], "digests": digests, "pairs": keys % self.span, "times": times, "ends": ends}


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    at, texts = 0, b.column(column)
    while at < b.num_rows:
        end, size = at, 0
        while end < b.num_rows and (end == at or size < BATCH):
            size += len(t.as_buffer()) if (t := texts[end]).is_valid else 0
            end += 1
        yield b.slice(at, end - at)
        at = end


def aligned(docs: DataFrame, a: bytes, b: bytes) -> tuple[DataFrame, int]:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each row of ``docs``, written to the shared
    folder, and the size of the second vocabulary."""
    files = docs.sparkSession.sparkContext.broadcast((a, b))  # two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, row = Aligner(ByteLevel(files.value[0]), Pieces(files.value[1])), TaskContext.get().partitionId() << 40
        for whole in batches:
            for part in _slices(whole, 1):
                got, n = align(part.column(1).to_pylist()), part.num_rows
                ends = pa.array(got["ends"], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(got[x], pa.int64())) for x in ("pairs", "times")]
                columns = [pa.array(np.arange(row, row + n)), part.column(0), *(pa.array(c) for c in got["sums"].T), pa.array(got["digests"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += n

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)
    return scratch(rows, "aligned"), len(Pieces(b).bytes)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) for every pair of ids that is linked somewhere: in how many rows, and whether no other pair with the
    same first id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch(counts, "pairs")
    first = F.floor(F.col("pair") / width).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    joined = counts.withColumn("first", F.floor(F.col("pair") / width)).join(F.broadcast(most), "first")  # at most one row for each id of a vocabulary
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    found = counts.orderBy("pair").toArrow()
    known = rows.sparkSession.sparkContext.broadcast((found.column("pair").to_numpy(), found.column("n").to_numpy(), found.column("best").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for b in batches:
            lists = b.column(b.num_columns - 2)
            at = np.searchsorted(pairs, lists.flatten().to_numpy(zero_copy_only=False))
            times = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(np.diff(s), pa.int64()) for s in sums)], names=[*b.schema.names[:-2], "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(tidy(run), schema)


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    sums = links.join(counts, links.pairs == counts.pair).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))


def alignment(docs: DataFrame, a: bytes, b: bytes, largest: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` and ``b`` are the contents of a byte-level JSON and of a piece model file. Texts that are null or empty, or whose
    tokens of either side do not give a space and the text, have zeros and the digest ''. Repeated rows count as documents
    of their own; ties for the best pair are all best; a null doc_id stays null. Long texts are aligned in whole; a group
    keeps each different pair of its ids once, with its number. Other columns are not read, and an empty table gives an
    empty result.
    """
    rows, width = aligned(docs, a, b)
    counts = pair_counts(rows, width)
    some = counts.count() <= largest
    return (_looked_up if some else _joined)(rows, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def read(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, by Spark's reader, so that it may be anywhere."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)
