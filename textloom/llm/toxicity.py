"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector and the mean vector of its character trigrams. Each text is cut into overlapping
windows of words; every window is scored, and a document's score is that of its worst window. The network is trained
with numpy on a bounded sample of labelled documents: first on windows that carry their document's label, then, in
rounds, on the worst window of each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
TRIGRAMS = 4096
VOCABULARY = 20_000
#: Labelled documents of each class that training takes at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 3000
#: Labelled texts with more bytes than this are not learnt from (all are scored), so the sample's bytes are bounded too.
SAMPLE_BYTES = 250_000
STEPS, BATCH, ROUNDS = 200, 128, 5
RATE, FLOOR, DECAY = 0.01, 1e-3, 0.3
CACHE_WORDS = 200_000
#: ASCII letters, digits and the bytes of all other characters make words.
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_BYTES).split() if text else []


def trigrams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of ``^word$`` for all words, one after the other, and how many each word has."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum(size + 2)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    code = (flat[at] << np.uint64(16)) | (flat[at + 1] << np.uint64(8)) | flat[at + 2]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TRIGRAMS, size


class Features:
    """Ids of words, with the vocabulary entry (0: unknown) and the trigrams of each id; id 0 is the padding."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.word, self.grams, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)

    def add(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of each text's words."""
        new = sorted(set().union(*(set(ws).difference(self.ids) for ws in texts)))
        if new:
            start = len(self.ids) + 1
            self.ids.update(zip(new, range(start, start + len(new)), strict=True))
            grams, size = trigrams_of(new)
            self.word = np.concatenate([self.word, np.array([self.vocabulary.get(w, 0) for w in new], np.int64)])
            self.grams, self.size = np.concatenate([self.grams, grams]), np.concatenate([self.size, size])
        get = self.ids.__getitem__
        return [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in texts]

    def arrays(self, since: int = 0, grams_since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.word[since:], self.grams[grams_since:], self.size[since:]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text, padded with 0; together they hold every word."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1) if len(ids) else 0
    padded = np.zeros(max(0, (n - 1) * STRIDE + WINDOW) if n else 0, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE] if n else np.zeros((0, WINDOW), np.int32)


def initial(n_words: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
    p = {"word": draw(n_words + 1, WORD_DIM, by=0.1), "gram": draw(TRIGRAMS, CHAR_DIM, by=0.1)}
    for d in "fb":
        p |= {f"W{d}": draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def inputs(p: Params, word: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.concatenate([p["word"][word], np.add.reduceat(p["gram"][grams], starts, axis=0) / size[:, None].astype(np.float32)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _recur(xs: np.ndarray, at: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, HIDDEN, windows) of one direction; xs: projected input (ids, 3 HIDDEN), at: ids by time."""
    n, k = at.shape[1], HIDDEN
    h, states, trace, ut = np.zeros((k, n), np.float32), np.empty((len(at), k, n), np.float32), [], np.ascontiguousarray(u.T)
    for t in range(len(at)):
        x, g = np.ascontiguousarray(xs[at[t]].T), ut @ h
        x[: 2 * k] += g[: 2 * k]
        zr = x[: 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r, gn = zr[:k], zr[k:], g[2 * k :]
        c = x[2 * k :]
        c += r * gn
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        new *= mask[t]
        if keep:
            trace.append((h, z, r, c, gn))
        states[t] = h = new
    return states, trace


def project(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}


def forward(p: Params, windows: np.ndarray, projected: dict[str, np.ndarray], keep: bool = False):
    """Logits of windows of ids into the projected inputs; with ``keep`` also what :func:`gradients` needs."""
    at = np.ascontiguousarray(windows.T)
    mask = (at > 0).astype(np.float32)
    f, tf = _recur(projected["f"], at, mask, p["Uf"], keep)
    b, tb = _recur(projected["b"], at[::-1], mask[::-1], p["Ub"], keep)
    b = b[::-1]
    k = HIDDEN
    score = np.einsum("k,tkn->tn", p["att"][:k], f) + np.einsum("k,tkn->tn", p["att"][k:], b)
    score -= np.float32(1e9) * (1 - mask)
    score -= score.max(0)
    a = np.exp(score)
    a /= a.sum(0)
    # the output is linear, so states are weighed first and pooled after
    of, ob = np.einsum("k,tkn->tn", p["out"][:k], f), np.einsum("k,tkn->tn", p["out"][k:], b)
    logit = (a * (of + ob)).sum(0) + p["bias"][0]
    return (logit, (at, mask, f, b, a, tf, tb)) if keep else logit


def gradients(p: Params, feats, x: np.ndarray, kept, delta: np.ndarray) -> Params:
    """Gradients of the sum of delta * logit by all parameters (back-propagation through time)."""
    at, mask, f, b, a, tf, tb = kept
    word, grams, size = feats
    k = HIDDEN
    weighed = a * delta
    g = {"out": np.concatenate([np.einsum("tn,tkn->k", weighed, f), np.einsum("tn,tkn->k", weighed, b)]), "bias": np.array([delta.sum()], np.float32)}
    da = (np.einsum("k,tkn->tn", p["out"][:k], f) + np.einsum("k,tkn->tn", p["out"][k:], b)) * delta
    ds = a * (da - (a * da).sum(0))
    g["att"] = np.concatenate([np.einsum("tn,tkn->k", ds, f), np.einsum("tn,tkn->k", ds, b)])
    dx = np.zeros_like(x)
    for d, half, steps, trace in (("f", slice(0, k), at, tf), ("b", slice(k, 2 * k), at[::-1], tb)):
        turn = (lambda v: v) if d == "f" else (lambda v: v[::-1])
        m, wt, st = turn(mask), turn(weighed), turn(ds)
        o, att, u = p["out"][half][:, None], p["att"][half][:, None], p[f"U{d}"]
        dh = np.zeros((k, at.shape[1]), np.float32)
        gu, parts = np.zeros_like(u), np.empty((*at.shape, 3 * k), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, c, gn = trace[t]
            dh = (dh + o * wt[t] + att * st[t]) * m[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r])
            gu += h @ du.T
            parts[t] = np.concatenate([dz, dr, dc]).T
            dh = dh * z + u @ du
        order = np.argsort(steps, axis=None, kind="stable")
        first = np.searchsorted(steps.ravel()[order], np.arange(len(x)))
        sums = np.add.reduceat(parts.reshape(-1, 3 * k)[order], np.minimum(first, len(order) - 1), axis=0)
        sums[np.diff(np.append(first, len(order))) == 0] = 0
        g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = gu, sums.sum(0), x.T @ sums
        dx += sums @ p[f"W{d}"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], word, dx[:, :WORD_DIM])
    np.add.at(g["gram"], grams, np.repeat(dx[:, WORD_DIM:] / size[:, None], size, axis=0))
    return g


class Adam:
    """Adam whose floor under the step keeps rare words from being learnt by heart; vectors of words fade by DECAY."""

    def __init__(self, p: Params, rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: Params) -> None:
        self.n += 1
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.005 * (g[k] * g[k] - self.v[k])
            table = k in ("word", "gram")
            x -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.995**self.n)) + (FLOOR if table else 1e-7))
            if table:
                x *= 1 - self.rate * DECAY


def _train_step(opt: Adam, feats, windows: np.ndarray, y: np.ndarray) -> None:
    ids, local = np.unique(windows, return_inverse=True)  # the parts of the features that this batch uses
    if ids[0] != 0:
        ids, local = np.concatenate([[0], ids]), local + 1
    local = local.reshape(windows.shape)
    word, grams, size = feats
    ends = np.cumsum(size)
    own = np.concatenate([grams[ends[i] - size[i] : ends[i]] for i in ids])
    mine = (word[ids], own, size[ids])
    x = inputs(opt.p, *mine)
    logit, kept = forward(opt.p, local, project(opt.p, x), keep=True)
    delta = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    opt.step(gradients(opt.p, mine, x, kept, delta))


def train(words: list[list[bytes]], labels: list[int], seed: int = 7) -> tuple[Params, dict[bytes, int]]:
    """Parameters and vocabulary from the words of labelled texts, which it takes away; without texts of both classes the bias alone speaks."""
    df = Counter(w for ws in words for w in set(ws))
    vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= max(3, len(words) // 500)}
    p = initial(len(vocabulary), seed)
    y = np.array(labels, np.float32)
    # Training starts from the log-odds of each word's documents in the first dimension of its vector.
    hits = np.zeros((2, len(vocabulary) + 1))
    for ws, c in zip(words, labels, strict=True):
        hits[c, [vocabulary[w] for w in set(ws) if w in vocabulary]] += 1
    odds = (hits + 0.5) / (np.bincount(np.array(labels, np.int64), minlength=2)[:, None] + 1)
    p["word"][1:, 0] = (0.25 * np.log(odds[1] / odds[0]) * hits.sum(0) / (hits.sum(0) + 10))[1:]
    if not len(y) or y.min() == y.max():
        p["out"][:] = 0
        p["bias"][:] = 4 if len(y) and y[0] == 1 else -4
        return p, vocabulary
    feats = Features(vocabulary)
    windows = [windows_of(ids) for ids in feats.add(words)]
    words.clear()
    del df, hits, odds
    feats.ids = {}
    arrays = feats.arrays()
    full = [k for k, w in enumerate(windows) if len(w)]
    by = [[k for k in full if y[k] == c] for c in (0, 1)]
    rng, opt = np.random.default_rng(seed), Adam(p, RATE)
    for _ in range(STEPS):
        docs = [int(rng.choice(by[j % 2])) for j in range(BATCH)]
        _train_step(opt, arrays, np.stack([windows[k][rng.integers(len(windows[k]))] for k in docs]), y[docs])
    flat = np.concatenate([windows[k] for k in full])
    owner = np.repeat(np.arange(len(full)), [len(windows[k]) for k in full])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    for round_ in range(ROUNDS):
        opt.rate = RATE * 0.6**round_
        logit = score_windows(p, flat, project(p, inputs(p, *arrays)))
        order = np.lexsort((-logit, owner))
        worst = order[starts]
        second = order[np.minimum(starts + 1, len(order) - 1)]
        second = second[(owner[second] != owner[worst]) | (y[np.array(full)[owner[worst]]] == 0)]  # clean texts are clean in every window
        second = second[y[np.array(full)[owner[second]]] == 0]
        hard = np.concatenate([worst, second])
        target = y[np.array(full)[owner[hard]]]
        for _ in range(max(1, round(40 * BATCH / len(hard)))):
            for part in np.array_split(rng.permutation(len(hard)), max(1, len(hard) // BATCH)):
                _train_step(opt, arrays, flat[hard[part]], target[part])
    return p, vocabulary


def score_windows(p: Params, windows: np.ndarray, projected: dict[str, np.ndarray], chunk: int = 1024) -> np.ndarray:
    parts = [forward(p, windows[i : i + chunk], projected) for i in range(0, len(windows), chunk)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


class Scorer:
    """Scores texts; what it knows about words is kept between calls, up to a bound."""

    def __init__(self, p: Params, vocabulary: dict[bytes, int]) -> None:
        self.p, self.feats = p, Features(vocabulary)
        self._restart()

    def _restart(self) -> None:
        self.feats.clear()
        self.grams_done, self.projected = 0, {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.feats.ids) > CACHE_WORDS:
            self._restart()
        windows = [windows_of(ids) for ids in self.feats.add([words_of(t) for t in texts])]
        done = len(self.projected["f"])
        if done < len(self.feats.word):
            new = project(self.p, inputs(self.p, *self.feats.arrays(done, self.grams_done)))
            self.grams_done = len(self.feats.grams)
            self.projected = {d: np.concatenate([self.projected[d], new[d]]) for d in "fb"}
        out = np.zeros(len(texts))
        n = np.array([len(w) for w in windows])
        if n.sum():
            logit = score_windows(self.p, np.concatenate([w for w in windows if len(w)]), self.projected)
            full = np.flatnonzero(n)
            worst = np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(n[full])[:-1]]))
            out[full] = 1 / (1 + np.exp(-worst.astype(np.float64)))
        return out


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> list[tuple[str | None, int]]:
    """At most ``toxic`` and ``clean`` labelled texts that are not held out, by a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, toxic), (0, clean))]
    few = picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # bounded by the parameters, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.octet_length("text") <= SAMPLE_BYTES) | F.col("text").isNull())
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return [(r.text, r.toxic) for r in rows]


def _scores(scorer: Scorer, texts: pa.Array) -> np.ndarray:
    """Scores of a batch, of which a few megabytes at a time become Python strings."""
    at, scores = 0, [np.zeros(0)]
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < 2 << 20):
            size += len(t.as_buffer()) if (t := texts[end]).is_valid else 0
            end += 1
        scores.append(scorer(texts.slice(at, end - at).to_pylist()))
        at = end
    return np.concatenate(scores)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            got = _scores(scorer, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """A broadcast model; its size is bounded by the vocabulary."""
    texts, marks = zip(*sample, strict=True) if (sample := labelled_sample(docs, labels)) else ((), ())
    words = [words_of(t) for t in texts]
    del sample, texts
    return spark.sparkContext.broadcast(train(words, list(marks)))


def toxicity(docs: DataFrame, model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. A text without words, null and empty ones too,
    has no window and scores 0. A null doc_id counts as the id "" in held_out. Ties cannot occur; repeated rows are
    repeated; an empty table gives an empty result. Without labelled texts of both classes every other score is the same
    constant. Other columns are not read; long texts are scored in whole, a batch holds few of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_score(model)), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns, whatever their names, in one pass
    without a shuffle. Only texts travel to Python, and only scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*model.value)
        yield from tidy(lambda given: (pa.array(_scores(scorer, texts)) for texts in given))(batches)

    return docs.where(score(F.col("text").cast("string")) < 0.5)
