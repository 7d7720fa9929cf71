"""Language identification by interpolated Kneser-Ney character models.

A text is its letters and marks in lower case, with one space for every run of anything else. Each language's model is
counted over the whole text of every learnable document with a language: n-grams of ``ORDER`` characters as they occur,
shorter ones by how many different characters they follow. Counts, discounts and interpolated probabilities are Spark
aggregates and joins. What comes of them is stored in sorted arrays of 64-bit hashes, one for each order, which tasks
search; where those arrays are larger than ``MODEL_BYTES``, documents' n-grams are joined with the tables instead, with
the same result.

A document gets the language whose cross-entropy, divided by the text's length, is lowest. A quarter of the documents is
learnt from for two things only: how far a text of a length can be from its own language's model (beyond that the answer
is marked as rejected), and how steeply scores follow differences.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, tidy

ORDER = 5
#: Largest size of the arrays that are sent to tasks.
MODEL_BYTES = 96 << 20
#: Characters that are looked up at a time.
BLOCK = 1 << 19
#: The share of texts in their own language that may be rejected.
REJECT = 0.001
#: Standard deviations from the mean that are never rejected, which tells where calibration has few texts.
SPREAD = 4.0
#: Calibration texts from which a limit is taken.
FEWEST = 20
#: Steepness of scores, from which calibration picks one.
STEEPNESS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
SPACE = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


@cache
def _kept() -> np.ndarray:
    """By code point, whether it is a letter or a mark."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def codes(text: str, order: int) -> np.ndarray:
    """Code points of a text as models see it, behind ``order - 1`` spaces and before one; none where it has no letter."""
    parts = [np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4") for at in range(0, len(text), BLOCK)]
    raw = np.concatenate([np.zeros(0, "<u4"), *parts])
    raw = np.where(_kept()[raw], raw, SPACE)
    raw = raw[(raw != SPACE) | (np.concatenate([[SPACE], raw[:-1]]) != SPACE)]
    if not any(c.isalpha() for c in map(chr, np.unique(raw))):
        return np.zeros(0, np.uint32)
    raw = raw[:-1] if raw[-1] == SPACE else raw
    return np.concatenate([np.full(order - 1, SPACE, np.uint32), raw, [SPACE]]).astype(np.uint32)


def blocks(sequences: list[np.ndarray], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of ``order`` codes that end at each character behind the leading spaces, a bounded number at a time, with
    the number of the sequence that each is of."""
    at, size, of = [], 0, []
    for k, s in enumerate(sequences):
        for start in range(0, max(0, len(s) - order + 1), BLOCK):
            piece = s[start : start + BLOCK + order - 1]
            at.append(np.lib.stride_tricks.sliding_window_view(piece, order))
            of.append(np.full(len(at[-1]), k))
            size += len(at[-1])
            if size >= BLOCK:
                yield np.concatenate(at), np.concatenate(of)
                at, size, of = [], 0, []
    if at:
        yield np.concatenate(at), np.concatenate(of)


def hashes(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of codes."""
    h = np.full(len(windows), windows.shape[1], np.uint64)
    for column in windows.T:
        h = (h ^ column.astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def strings(windows: np.ndarray) -> list[str]:
    flat = np.ascontiguousarray(windows, np.uint32)
    return flat.view(f"<U{flat.shape[1]}").ravel().tolist()


def grams_of(windows: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Different rows of codes as strings, and how often each occurs."""
    h = hashes(windows)
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    return strings(windows[first]), n


class Hashed:
    """Values by 64-bit hash: a sorted array, entered by the leading bits of the hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, or -1."""
        out = np.full(len(h), -1)
        if not len(self.keys):
            return out
        left, at = np.arange(len(h)), self.start[h >> self.shift]
        while len(left):
            inside = at < len(self.keys)
            left, at = left[inside], at[inside]
            here = self.keys[at]
            hit = here == h[left]
            out[left[hit]] = at[hit]
            on = here < h[left]
            left, at = left[on], at[on] + 1
        return out


class Model:
    """Log probabilities of n-grams and weights of contexts for all languages, by order."""

    def __init__(self, langs: list[str], order: int, grams: list[Hashed], contexts: list[Hashed], floor: np.ndarray) -> None:
        self.langs, self.order, self.grams, self.contexts, self.floor = langs, order, grams, contexts, floor

    def logs(self, windows: np.ndarray) -> np.ndarray:
        """Natural logs of the probability of each row's last code after the others, in each language: that of the longest
        known end of the row, less what its unknown contexts cost."""
        out = np.zeros((len(windows), len(self.langs)))
        left = np.arange(len(windows))
        for k in range(self.order, 0, -1):
            ends = windows[left, self.order - k :]
            at = self.grams[k - 1].find(hashes(ends))
            out[left[at >= 0]] += self.grams[k - 1].values[at[at >= 0]]
            left, ends = left[at < 0], ends[at < 0]
            if k > 1 and len(left):
                at = self.contexts[k - 1].find(hashes(ends[:, :-1]))
                out[left[at >= 0]] += self.contexts[k - 1].values[at[at >= 0]]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its cross-entropy a character in each language, and its characters (0: no letter)."""
        sequences = [codes(t or "", self.order) for t in texts]
        n = np.array([max(0, len(s) - self.order + 1) for s in sequences])
        total = np.zeros((len(texts), len(self.langs)))
        for windows, of in blocks(sequences, self.order):
            part = self.logs(windows)
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            total[of[cuts]] -= np.add.reduceat(part, cuts)
        return total / np.maximum(n, 1)[:, None], n


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, of whose texts some megabytes at a time."""
    at, texts = 0, b.column(column)
    while at < b.num_rows:
        end, size = at, 0
        while end < b.num_rows and (end == at or size < BLOCK):
            size += len(t.as_buffer()) if (t := texts[end]).is_valid else 0
            end += 1
        yield b.slice(at, end - at)
        at = end


def counted(learn: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, lang, gram, c) for the rows (lang, text): occurrences of n-grams of the order, and for shorter ones the number
    of different characters before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    for windows, _ in blocks([codes(t, order) for x, t in zip(langs, texts, strict=True) if x == lang], order):
                        grams, n = grams_of(windows)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.string()), "c": pa.array(n, pa.int64())})

    rows = learn.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    level = scratch(rows.mapInArrow(tidy(run), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), f"grams{order}")
    out = level.withColumn("k", F.lit(order))
    for k in range(order - 1, 0, -1):
        level = scratch(level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"grams{k}")
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out


def _pivot(df: DataFrame, keys: list[str], value: str, langs: list[str], default: float) -> DataFrame:
    cells = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col(value))), F.lit(default)) for x in langs]
    return df.groupBy(*keys).agg(F.array(*cells).alias(value))


def interpolated(counts: DataFrame, langs: list[str], order: int = ORDER) -> tuple[DataFrame, DataFrame, list[float]]:
    """Tables (k, gram, p) and (k, context, w) of probabilities and back-off weights, arrays by language, and the
    probability of a character that no text has, by language."""
    one = F.lit(1.0)
    n1, n2 = F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double"))
    discount = F.when(n1 + n2 > 0, F.greatest(F.lit(0.05), n1 / (n1 + 2 * n2))).otherwise(0.5)
    discounts = counts.groupBy("k", "lang").agg(F.least(F.lit(0.95), discount).alias("d"))
    with_d = counts.join(F.broadcast(discounts), ["k", "lang"]).withColumn("context", F.expr("substring(gram, 1, k - 1)"))  # one row for each language and order
    sums = with_d.groupBy("k", "lang", "context").agg(F.sum("c").alias("total"), (F.max("d") * F.count("*") / F.sum("c")).alias("w"))
    seen = with_d.join(sums, ["k", "lang", "context"]).withColumn("p", (F.col("c") - F.col("d")) / F.col("total"))
    own = scratch(_pivot(seen, ["k", "gram"], "p", langs, 0.0), "seen")
    weights = scratch(_pivot(sums, ["k", "context"], "w", langs, 1.0), "weights")
    size = own.where("k = 1").count() + 1
    first = weights.where("k = 1").first()
    floor = [w / size for w in first.w] if first else []
    level = own.where("k = 1").select("k", "gram", F.zip_with("p", F.array(*map(F.lit, floor)), lambda p, f: p + f).alias("p"))
    out = level
    for k in range(2, order + 1):
        shorter = level.select(F.col("gram").alias("end"), F.col("p").alias("q"))
        back = weights.where(F.col("k") == k).select("context", "w")
        level = own.where(F.col("k") == k).withColumns({"context": F.substring("gram", 1, k - 1), "end": F.substring("gram", 2, k)}).join(back, "context", "left").join(shorter, "end")
        w = F.coalesce("w", F.array(*[one] * len(langs)))
        level = scratch(level.select("k", "gram", F.zip_with("p", F.zip_with(w, "q", lambda a, b: a * b), lambda p, r: p + r).alias("p")), f"model{k}")
        out = out.unionByName(level)
    return out, weights, floor


def _arrays(rows: DataFrame, name: str, value: str, k: int, langs: list[str]) -> Hashed:
    found = rows.where(F.col("k") == k).select(name, value).toArrow()
    if k == 1 and name == "context" or not found.num_rows:
        return Hashed(np.zeros(0, np.uint64), np.zeros((0, len(langs))))
    text = found.column(name).to_pylist()
    windows = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(text), -1)
    values = found.column(value).combine_chunks().flatten().to_numpy().reshape(len(text), len(langs))
    return Hashed(hashes(windows), np.log(values))


class Fitted:
    """Languages, the tables of their models, and the arrays that tasks search, where these are small enough."""

    def __init__(self, langs: list[str], order: int, grams: DataFrame, contexts: DataFrame, floor: list[float], arrays: Broadcast | None) -> None:
        self.langs, self.order, self.grams, self.contexts, self.floor, self.arrays = langs, order, grams, contexts, floor, arrays


def fit(docs: DataFrame, order: int = ORDER, largest: int = MODEL_BYTES) -> Fitted | None:
    """Models of the languages of the rows (lang, text) that are neither held out nor kept for calibration; None without
    such rows. Whole texts of all those rows are counted; a null lang or text teaches nothing."""
    learn = docs.where(~fold().isin(HELD_OUT, CALIBRATE))
    counts = counted(learn, order)
    langs = sorted(r.lang for r in counts.where("k = 1").select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    grams, contexts, floor = interpolated(counts, langs, order)
    arrays = None
    if (grams.count() + contexts.count()) * 8 * (2 + len(langs)) <= largest:
        tables = [[_arrays(rows, name, value, k, langs) for k in range(1, order + 1)] for rows, name, value in ((grams, "gram", "p"), (contexts, "context", "w"))]
        arrays = docs.sparkSession.sparkContext.broadcast(Model(langs, order, *tables, np.log(floor)))
    return Fitted(langs, order, grams, contexts, floor, arrays)


def _searched(rows: DataFrame, fitted: Fitted) -> DataFrame:
    model = fitted.arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 3):
                h, n = model.value.entropies(part.column(3).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), lists, pa.array(n, pa.int64())], names=["doc_id", "fold", "lang", "h", "n"])

    return rows.mapInArrow(tidy(run), "doc_id long, fold int, lang string, h array<double>, n long")


def _joined(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The same by joins: n-grams of different texts meet the tables, frequent ones once for all texts."""
    order, langs = fitted.order, fitted.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                for sha, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for windows, _ in blocks([codes(text or "", order)], order):
                        grams, n = grams_of(windows)
                        yield pa.RecordBatch.from_pydict({"sha": pa.array([sha] * len(grams), pa.string()), "gram": pa.array(grams, pa.string()), "c": pa.array(n, pa.int64()), "block": pa.array([int(hashes(windows[:1])[0] >> np.uint64(1))] * len(grams), pa.int64())})

    keyed = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = keyed.select("sha", "text").mapInArrow(tidy(run), "sha string, gram string, c long, block long").distinct().groupBy("sha", "gram").agg(F.sum("c").alias("c"))
    held = scratch(held, "held")
    zero, add = F.array(*[F.lit(0.0)] * len(langs)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    left, parts = held.select("gram").distinct().select("gram", F.col("gram").alias("end"), zero.alias("h")), []
    for k in range(order, 0, -1):
        known = fitted.grams.where(F.col("k") == k).select(F.col("gram").alias("end"), F.transform("p", lambda x: F.log(x)).alias("p"))
        both = left.join(known, "end", "left")
        parts.append(both.where("p is not null").select("gram", add("h", "p").alias("h")))
        both = both.where("p is null").withColumn("context", F.substring("end", 1, k - 1))
        if k > 1:
            cost = fitted.contexts.where(F.col("k") == k).select("context", F.transform("w", lambda x: F.log(x)).alias("w"))
            left = both.join(cost, "context", "left").select("gram", F.substring("end", 2, k).alias("end"), F.when(F.col("w").isNull(), F.col("h")).otherwise(add("h", "w")).alias("h"))
        else:
            parts.append(both.select("gram", add("h", F.transform(F.array(*map(F.lit, fitted.floor)), lambda x: F.log(x))).alias("h")))
    logs = parts[0]
    for p in parts[1:]:
        logs = logs.union(p)
    sums = held.join(logs, "gram").groupBy("sha").agg(F.array(*(-F.sum(F.col("c") * F.col("h")[i]) for i in range(len(langs)))).alias("total"), F.sum("c").alias("n"))
    out = keyed.drop("text").join(sums, "sha", "left")
    h = F.when(F.col("n").isNull(), zero).otherwise(F.transform("total", lambda x: x / F.col("n")))
    return out.select("doc_id", "fold", "lang", h.alias("h"), F.coalesce("n", F.lit(0)).alias("n"))


def entropies(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, fold, lang, h, n) for each row: cross-entropies a character by language, and characters."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("fold"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    return _searched(rows, fitted) if fitted.arrays is not None else _joined(rows, fitted)


def _posterior(steep: float, n: str, h: str, best: str) -> Column:
    """Share of the best language if each has the weight exp(-steepness * square root of the length * entropy)."""
    scale = F.sqrt(n) * steep
    return 1 / F.aggregate(h, F.lit(0.0), lambda s, x: s + F.exp(-scale * (x - F.col(best))))


def identify(docs: DataFrame, fitted: Fitted | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected, entropy.

    Without ``fitted`` the models are learnt from ``docs`` (doc_id, text, lang). lang_pred is the language with the lowest
    cross-entropy a character, of equal ones the first by name; ``und`` with score 0 where text is null or empty or has no
    letter, or nothing could be learnt. rejected: the text is farther from that language's model than all but one in a
    thousand texts of that language and about that length (powers of two), and by more than ``SPREAD`` standard deviations;
    lengths with fewer than ``FEWEST`` calibration texts are never rejected. A null doc_id counts as the id "". Repeated rows are repeated, long texts read in whole, other columns not
    read, and an empty table gives an empty result.
    """
    fitted = fit(docs) if fitted is None else fitted
    if fitted is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"), F.lit(None).cast("double").alias("entropy"))
    names = F.array(*map(F.lit, fitted.langs))
    rows = entropies(docs, fitted).withColumns({"size": F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int"), "low": F.array_min("h")})
    rows = scratch(rows.withColumn("best", F.element_at(names, F.array_position("h", F.col("low")).cast("int"))), "entropies")
    known = rows.where((F.col("fold") == CALIBRATE) & (F.col("n") > 0)).withColumn("own", F.element_at("h", F.array_position(names, F.col("lang")).cast("int"))).where("own is not null")
    limits = known.groupBy(F.col("lang").alias("best"), "size").agg(F.greatest(F.percentile_approx("own", F.lit(1 - REJECT), F.lit(10_000)), F.avg("own") + SPREAD * F.stddev("own")).alias("limit"), F.count("*").alias("n")).where(F.col("n") >= FEWEST).drop("n")
    fits = known.agg(*(F.sum(F.log(F.greatest(F.lit(1e-12), _posterior(s, "n", "h", "own")))).alias(str(i)) for i, s in enumerate(STEEPNESS))).first()
    steep = max(zip(fits, STEEPNESS, strict=True))[1] if fits[0] is not None else 1.0
    some = F.col("n") > 0
    return rows.join(F.broadcast(limits), ["best", "size"], "left").select(  # one row for each language and power of two
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        F.when(some, F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(some, _posterior(steep, "n", "h", "low")).otherwise(0.0).alias("score"),
        (some & F.coalesce(F.col("low") > F.col("limit"), F.lit(False))).alias("rejected"),
        F.when(some, F.col("low")).alias("entropy"),
    )
